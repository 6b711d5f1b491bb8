"""Fusion of ranked lists: one row per (method, id) with rank and score, in one of three dialects.

`query` sums plain scores; `search` divides weighted scores by their method's largest; `controller` keys hits by their
content. Failed methods simply bring no rows. Ties fall to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
METHODS = ("rrf", "weighted", "max", "comb_sum", "comb_mnz")
#: Weights of the search dialect, and what other methods weigh in each dialect.
SEARCH_WEIGHTS = {"vector": 0.5, "lazy": 0.5, "keyword": 0.3}
OTHER_WEIGHT = {"query": 0.5, "search": 1.0, "controller": 1.0}


def _weight(weights: dict[str, float] | None, other: float) -> Column:
    if not weights:
        return F.lit(other)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(weights.items()) for x in kv]), F.col("method")), F.lit(other))


def fuse(lists: DataFrame, method: str = "rrf", dialect: str = "query", weights: dict[str, float] | None = None, k: int | None = 10, key: str = "id") -> DataFrame:
    """(key, score, n_sources) by falling score."""
    weight = _weight(weights or (SEARCH_WEIGHTS if dialect == "search" else None), OTHER_WEIGHT[dialect])
    if method == "rrf":
        score = F.sum(1.0 / (RRF_K + F.col("rank")))
    elif method == "weighted":
        if dialect == "search":
            top = F.max("score").over(Window.partitionBy("method"))
            lists = lists.withColumn("top", top).withColumn("score", F.col("score") / F.when(F.col("top") == 0, 1.0).otherwise(F.col("top")))
        score = F.sum(F.col("score") * weight)
    elif method == "max":
        score = F.greatest(F.max("score"), F.lit(0.0)) if dialect == "query" else F.max("score")
    elif method == "comb_sum":
        score = F.sum("score")
    elif method == "comb_mnz":
        score = F.sum("score") * F.count("*")
    else:
        raise ValueError(f"unknown fusion method {method!r}")
    sources = F.count_distinct("method") if dialect == "search" else F.count("*")
    merged = lists.groupBy(key).agg(F.round(score, 6).alias("score"), sources.alias("n_sources")).orderBy(F.desc("score"), key)
    return merged.limit(k) if k else merged


def controller_rrf(lists: DataFrame, key: str = "key") -> DataFrame:
    """Content-keyed reciprocal ranks, with best rank, best original score and engines."""
    return lists.groupBy(key).agg(
        F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 6).alias("score"), F.min("rank").alias("best_rank"), F.max("score").alias("best_score"),
        F.array_join(F.array_sort(F.collect_list("method")), ",").alias("engines"),
    )


def first_by(lists: DataFrame, order: list, key: str = "key") -> DataFrame:
    """The first row of each key in an order."""
    return lists.withColumn("_first", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_first = 1").drop("_first")


def controller_score(lists: DataFrame, key: str = "key") -> DataFrame:
    """Of each key the row of the highest score."""
    return first_by(lists, [F.desc("score"), "method"], key)


def controller_weighted(lists: DataFrame, weights: dict[str, float] | None = None, key: str = "key") -> DataFrame:
    """Weighted sums; a hit without a score counts one over its rank. (U8)"""
    own = F.coalesce(F.nullif("score", F.lit(0.0)), 1.0 / F.col("rank"))
    return lists.groupBy(key).agg(F.round(F.sum(own * _weight(weights, 1.0)), 6).alias("score"))


def interleave(lists: DataFrame, engines: list[str], k: int = 100, key: str = "key") -> DataFrame:
    """Round robin: by rank, then by the engines' order, each key once, the first k."""
    place = F.array_position(F.array(*map(F.lit, engines)), F.col("method"))
    once = first_by(lists.withColumn("_turn", place), ["rank", "_turn"], key)
    chosen = once.orderBy("rank", "_turn").limit(k)  # so that the window below sees k rows
    return chosen.withColumn("position", F.row_number().over(Window.orderBy("rank", "_turn"))).drop("_turn")


def level_priority(lists: DataFrame, key: str = "key") -> DataFrame:
    """Higher index levels first, then score."""
    return first_by(lists, [F.desc("level"), F.desc("score"), "method"], key)


def stream_merge(lists: DataFrame, k: int = 10, key: str = "id") -> DataFrame:
    """Best score of each id over engines."""
    return lists.groupBy(key).agg(F.max("score").alias("score")).orderBy(F.desc("score"), key).limit(k)
