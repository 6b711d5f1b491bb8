"""Merging what chunks report of the same entity or relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import normalise_entity, support_confidence


def _longest(column: str):
    """The longest value, the first one among equals."""
    return F.max_by(column, F.struct(F.length(F.coalesce(column, F.lit(""))), -F.col("pos")))


def merge_entities(found: DataFrame) -> DataFrame:
    """found: (pos, id, name, type, description, chunk, year, confidence). One row a normalised name: first id, name and
    type, other names as aliases, chunks, longest description, first year, confidence by support. (A9)"""
    key = normalise_entity(F.col("name"))
    grouped = found.withColumn("key", key).groupBy("key").agg(
        F.min_by("id", "pos").alias("id"), F.min_by("name", "pos").alias("name"), F.min_by("type", "pos").alias("type"), _longest("description").alias("description"),
        F.array_sort(F.collect_set("name")).alias("names"), F.array_sort(F.collect_set("chunk")).alias("chunks"),
        F.min_by("year", F.when(F.col("year").isNotNull(), F.col("pos"))).alias("year"), F.count("*").alias("n"), F.min_by("confidence", "pos").alias("own"),
    )
    aliases = F.array_except("names", F.array("name"))
    return grouped.select("key", "id", "name", "type", "description", F.array_join(aliases, "|").alias("aliases"), F.array_join("chunks", "|").alias("chunks"), "year", support_confidence(F.col("n"), F.col("own")).alias("confidence"))


def merge_relations(found: DataFrame) -> DataFrame:
    """found: (pos, source, type, target, description, evidence, chunk, confidence). (A10)"""
    key = F.concat_ws("|", F.lower("source"), "type", F.lower("target"))
    grouped = found.withColumn("key", key).groupBy("key").agg(
        _longest("description").alias("description"), _longest("evidence").alias("evidence"), F.array_sort(F.collect_set("chunk")).alias("chunks"), F.count("*").alias("n"), F.min_by("confidence", "pos").alias("own")
    )
    return grouped.select("key", "description", "evidence", F.array_join("chunks", "|").alias("chunks"), support_confidence(F.col("n"), F.col("own")).alias("confidence"), support_confidence(F.col("n"), F.lit(1.0), 0.15).alias("weight"))


def merge_maps(rows: DataFrame, key: str, column: str, order: str) -> DataFrame:
    """Maps merged, the last value of a name wins."""
    flat = rows.select(key, order, F.explode(column).alias("name", "value"))
    last = flat.groupBy(key, "name").agg(F.max_by("value", order).alias("value"))
    return last.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias(column))


def extract_relations(mentions: DataFrame) -> DataFrame:
    """(source, target, chunk): entities of one chunk are related, the default of the model seam. mentions: (chunk, entity),
    few a chunk, which are dealt out once and paired in a chunk's row."""
    listed = mentions.where("chunk IS NOT NULL").groupBy("chunk").agg(F.array_sort(F.collect_set("entity")).alias("all"))
    placed = listed.select("chunk", "all", F.posexplode("all").alias("place", "source"))
    return placed.select("source", F.explode(F.slice("all", F.col("place") + 2, F.size("all"))).alias("target"), "chunk")
