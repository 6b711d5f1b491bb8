"""Keyword scores and text predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import WORD, text, word_set
from lumenfold.storage import materialise


def overlap(query: str, body: Column) -> Column:
    """Share of the query's words that the text has; 0 for an empty query. (V5)"""
    words = word_set(F.lit(query))
    return F.when(F.size(words) == 0, 0.0).otherwise(F.size(F.array_intersect(words, word_set(body))) / F.size(words))


def contains_all(column: Column, query: str) -> Column:
    """The whole query stands in the text, without regard to case."""
    return F.contains(F.lower(text(column)), F.lit(query.lower()))


def substring_search(table: DataFrame, query: str, columns: list[str], k: int, key: str) -> DataFrame:
    """The first k rows by key with the query in one of the columns."""
    hit = contains_all(F.col(columns[0]), query)
    for c in columns[1:]:
        hit = hit | contains_all(F.col(c), query)
    return table.where(hit).orderBy(key).limit(k)


def any_contains(columns: Column, query: str) -> Column:
    """The query stands in one of an array's strings."""
    return F.exists(columns, lambda a: F.contains(F.lower(a), F.lit(query.lower())))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def bm25(docs: DataFrame, query: str, k: int = 10, k1: float = 1.2, b: float = 0.75, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(key, score): Okapi BM25 over the corpus. Only the query's words leave a task, with the document's length; corpus
    counts are one aggregate row. (V8)"""
    words = F.regexp_extract_all(F.lower(text(body)), F.lit(f"({WORD})"), F.lit(1))
    wanted = word_set(F.lit(query))
    listed = docs.select(key, words.alias("w")).select(key, F.size("w").alias("n"), F.filter("w", lambda x: F.array_contains(wanted, x)).alias("w"))
    hits = F.filter(F.transform(wanted, lambda t: F.struct(t.alias("term"), F.size(F.filter(F.col("w"), lambda x: x == t)).alias("tf"))), lambda s: s["tf"] > 0)
    sized = materialise(listed.select(key, "n", hits.alias("hits")))  # the texts are read once
    counts = sized.select(key, "n", F.explode("hits").alias("hit")).select(key, "n", "hit.*")
    corpus = sized.agg(F.count("*").alias("total"), F.avg("n").alias("mean"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    joined = counts.join(F.broadcast(df), "term").crossJoin(F.broadcast(corpus))  # one row a query word, and one row
    idf = F.log(1 + (F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return joined.withColumn("part", part).groupBy(key).agg(F.round(F.sum("part"), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def community_by_keywords(communities: DataFrame, query: str, k: int = 3, key: str = "community_id", phrases: str = "phrases") -> DataFrame:
    """(key, score): Jaccard of the query's words and the words of at most five representative phrases."""
    asked = F.array_distinct(F.split(F.lit(query.lower()), r"\s+"))
    own = F.array_distinct(F.flatten(F.transform(F.slice(phrases, 1, 5), lambda p: F.split(F.lower(p), r"\s+"))))
    scored = communities.select(key, F.round(jaccard(asked, own), 6).alias("score")).where("score > 0")
    return scored.orderBy(F.desc("score"), key).limit(k)


def ranked(scored: DataFrame, by: str = "method", key: str = "id") -> DataFrame:
    """Ranks from 1 within each list."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), key)))


def page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A page of totally ordered rows; the limit is held between 1 and 100."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(100, max(1, limit)))
