"""Exact vector search.

One query is an expression over the table and a TakeOrderedAndProject. Batches of queries are matrix products over
Arrow batches: each task keeps its k best of each query, so what is shuffled is tasks x queries x k rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that one pass takes along in its closure.
QUERY_BLOCK = 4096


def doubles(c: Column | str) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, guard: float = 0.0) -> Column:
    """0 where a norm is 0; with `guard`, that much is added to the norms instead."""
    if guard:
        return dot(a, b) / ((norm(a) + guard) * (norm(b) + guard))
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in vector])


def cosine_top_k(table: DataFrame, query: list[float], k: int = 10, least: float | None = None, threshold_first: bool = False, key: str = "vec_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """(key, score) by falling cosine. A threshold applies to the k best (V1, F3) or before they are chosen."""
    scored = table.select(key, F.round(cosine(doubles(vector), literal(query)), digits).alias("score"))
    if least is not None and threshold_first:
        scored = scored.where(F.col("score") >= least)
    best = scored.orderBy(F.desc("score"), key).limit(k)
    return best.where(F.col("score") >= least) if least is not None and not threshold_first else best


def l2_top_k(table: DataFrame, query: list[float], k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, distance, similarity) by rising squared distance; similarity is 1 - distance. (V3)"""
    gap = F.zip_with(doubles(vector), literal(query), lambda x, y: x - y)
    near = table.select(key, F.round(dot(gap, gap), 6).alias("distance")).orderBy("distance", key).limit(k)
    return near.withColumn("similarity", F.round(1 - F.col("distance"), 6))


def batch_top_k(table: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id") -> DataFrame:
    """(query_id, rank, key, score): k nearest by cosine for every query. (V4)

    Queries reach the tasks QUERY_BLOCK at a time; each block is one pass over the table.
    """
    spark = table.sparkSession
    blocks = max(1, -(-queries.count() * 5 // (4 * QUERY_BLOCK)))
    found = spark.createDataFrame([], f"{query_key} long, {key} long, score double")
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == b).select(query_key, doubles(vector).alias("v")).collect()
        ids = np.array([r[0] for r in rows], np.int64)
        matrix = np.array([r["v"] for r in rows], float).reshape(len(rows), -1)
        held = spark.sparkContext.broadcast((ids, matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, q = held.value
            best_s, best_k = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
            for batch in batches:
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(keys), -1)
                size = np.linalg.norm(v, axis=1, keepdims=True)
                scores = np.round(q @ np.divide(v, size, out=np.zeros_like(v), where=size > 0).T, 6)
                best_s, best_k = np.concatenate([best_s, scores], 1), np.concatenate([best_k, np.broadcast_to(keys, scores.shape)], 1)
                order = np.lexsort((best_k, -best_s), axis=1)[:, :k]
                best_s, best_k = np.take_along_axis(best_s, order, 1), np.take_along_axis(best_k, order, 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best_s.shape[1])), pa.array(best_k.ravel()), pa.array(best_s.ravel())], names=[query_key, key, "score"])

        found = found.unionByName(table.where(F.col(vector).isNotNull()).select(F.col(key).cast("long"), vector).mapInArrow(run, found.schema))
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def metadata_filter(table: DataFrame, direct: dict[str, str], metadata: dict[str, str] | None = None, column: str = "metadata") -> DataFrame:
    """Rows that equal all given values; a missing key never matches. Filters come before ranking. (F1)"""
    for name, value in direct.items():
        table = table.where(F.col(name) == value)
    for name, value in (metadata or {}).items():
        table = table.where(F.col(column)[name] == value)
    return table


def hybrid(vector_scores: DataFrame, keyword_scores: DataFrame, alpha: float = 0.5, k: int = 10, key: str = "doc_id") -> DataFrame:
    """(key, score): alpha * vector + (1 - alpha) * keyword over the union, a missing side counts 0. (V7)"""
    both = vector_scores.select(key, F.col("score").alias("v")).join(keyword_scores.select(key, F.col("score").alias("w")), key, "full_outer")
    mixed = F.round(alpha * F.coalesce("v", F.lit(0.0)) + (1 - alpha) * F.coalesce("w", F.lit(0.0)), 6)
    return both.select(key, mixed.alias("score")).orderBy(F.desc("score"), key).limit(k)


def best_of(runs: DataFrame, k: int = 10, key: str = "vec_id") -> DataFrame:
    """(key, score): the highest score of a hit over several queries. (V9)"""
    return runs.groupBy(key).agg(F.max("score").alias("score")).orderBy(F.desc("score"), key).limit(k)
