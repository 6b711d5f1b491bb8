"""Phrase graphs: statistics of phrases, and edges between phrases that stand near each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 5
MIN_FREQUENCY = 2


def often(phrases: DataFrame, least: int = MIN_FREQUENCY) -> DataFrame:
    """(phrase) of those seen at least `least` times."""
    return phrases.groupBy("phrase").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("phrase")


def frequent(phrases: DataFrame, least: int = MIN_FREQUENCY) -> DataFrame:
    """Rows (unit, doc_id, pos, phrase) of phrases seen at least `least` times. (F8)"""
    return phrases.join(often(phrases, least), "phrase", "left_semi")


def phrase_stats(phrases: DataFrame) -> DataFrame:
    """(phrase, frequency, n_docs, n_units). (A1)"""
    return phrases.groupBy("phrase").agg(F.count("*").alias("frequency"), F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("unit").alias("n_units"))


def neighbours(phrases: DataFrame, window: int = WINDOW) -> DataFrame:
    """(unit, doc_id, a, b): pairs of different phrases at most `window` places apart, places counted after filtering.

    The range join is a look ahead of constant width in each unit's own ordered list: no self-join. A unit is part of one
    document, and the units of a document come to one task, so that its pairs are counted where they are made. (J3)
    """
    order = Window.partitionBy("doc_id", "unit").orderBy("pos", "phrase")
    phrases = phrases.repartition("doc_id")
    ahead = F.collect_list("phrase").over(order.rowsBetween(1, window))
    pairs = phrases.withColumn("ahead", ahead).withColumn("near", F.explode("ahead"))
    return pairs.where(F.col("phrase") != F.col("near")).select("unit", "doc_id", F.least("phrase", "near").alias("a"), F.greatest("phrase", "near").alias("b"))


def edges(pairs: DataFrame) -> DataFrame:
    """(source, target, weight, n_docs) of each unordered pair. (A2, A3)"""
    by_document = pairs.groupBy("doc_id", "a", "b").agg(F.count("*").alias("n"))  # nothing is dealt out anew after `neighbours`
    return by_document.groupBy(F.col("a").alias("source"), F.col("b").alias("target")).agg(F.sum("n").alias("weight"), F.count("doc_id").alias("n_docs"))


def nodes(stats: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Statistics with the entity type of a phrase, the last one in `entities` (phrase, pos, type)."""
    if entities is None:
        return stats.withColumn("entity_type", F.lit(None).cast("string"))
    last = entities.groupBy(F.lower("phrase").alias("phrase")).agg(F.max_by("type", "pos").alias("entity_type"))
    return stats.join(last, "phrase", "left")


def representative(members: DataFrame, k: int = 5, community: str = "community", node: str = "node", weight: str = "frequency") -> DataFrame:
    """(community, phrases): the k most frequent nodes of each community. (A4)"""
    rank = F.row_number().over(Window.partitionBy(community).orderBy(F.desc(weight), node))
    top = members.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.groupBy(community).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", node))), lambda s: s[node]).alias("phrases"))


def undirected(e: DataFrame) -> DataFrame:
    return e.select("source", "target").unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target")))


def related_terms(e: DataFrame, node: str) -> DataFrame:
    """Neighbours of a node in either direction."""
    return undirected(e).where(F.col("source") == node).select(F.col("target").alias("node")).distinct()


def degree_centrality(e: DataFrame, k: int = 10) -> DataFrame:
    """(node, degree, centrality): degree / (n - 1), the k highest."""
    degrees = undirected(e).distinct().groupBy(F.col("source").alias("node")).agg(F.count("*").alias("degree"))
    n = degrees.agg(F.count("*").alias("n"))
    scored = degrees.crossJoin(F.broadcast(n))  # one row
    return scored.select("node", "degree", F.round(F.col("degree") / (F.col("n") - 1), 6).alias("centrality")).orderBy(F.desc("centrality"), "node").limit(k)
