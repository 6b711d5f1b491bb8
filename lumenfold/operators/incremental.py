"""Change detection between a state and a new snapshot, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify(old: DataFrame, new: DataFrame, check_deleted: bool = True) -> DataFrame:
    """(document_id, change_type, old_hash, new_hash, old_units, new_units) of states (document_id, content_hash, units).
    (I1, J16)"""
    o = old.select("document_id", F.col("content_hash").alias("old_hash"), F.col("units").alias("old_units"))
    n = new.select("document_id", F.col("content_hash").alias("new_hash"), F.col("units").alias("new_units"))
    both = o.join(n, "document_id", "full_outer")
    kind = F.when(F.col("old_hash").isNull(), "ADDED").when(F.col("new_hash").isNull(), "DELETED").when(F.col("old_hash") == F.col("new_hash"), "UNCHANGED").otherwise("MODIFIED")
    out = both.select("document_id", kind.alias("change_type"), "old_hash", "new_hash", "old_units", "new_units")
    return out if check_deleted else out.where("change_type <> 'DELETED'")


def unit_changes(changes: DataFrame) -> DataFrame:
    """(document_id, to_add, to_remove) by set difference."""
    none = F.array().cast("array<string>")
    new, old = F.coalesce("new_units", none), F.coalesce("old_units", none)
    case = lambda added, modified, deleted: F.when(F.col("change_type") == "ADDED", added).when(F.col("change_type") == "MODIFIED", modified).when(F.col("change_type") == "DELETED", deleted).otherwise(none)
    return changes.select("document_id", "change_type", case(new, F.array_except(new, old), none).alias("to_add"), case(none, F.array_except(old, new), old).alias("to_remove"))


def tracked_units(changes: DataFrame) -> DataFrame:
    """(unit, action): as the tracker counts, all units of a modified document are removed and added."""
    add = changes.where("change_type IN ('ADDED', 'MODIFIED')").select(F.explode("new_units").alias("unit"), F.lit("add").alias("action"))
    drop = changes.where("change_type IN ('DELETED', 'MODIFIED')").select(F.explode("old_units").alias("unit"), F.lit("remove").alias("action"))
    return add.unionByName(drop).distinct()


def applied(changes: DataFrame) -> DataFrame:
    """The next state. (I4)"""
    return changes.where("change_type <> 'DELETED'").select("document_id", F.col("new_hash").alias("content_hash"), F.col("new_units").alias("units"))


def change_counts(changes: DataFrame) -> DataFrame:
    """(change_type, n)."""
    return changes.groupBy("change_type").agg(F.count("*").alias("n"))


def total_changes(changes: DataFrame) -> DataFrame:
    """One row: changes without the unchanged."""
    return changes.agg(F.count_if(F.col("change_type") != "UNCHANGED").alias("n_changes"))


def strategy(old: DataFrame, changes: DataFrame, dry_run: bool = False) -> str:
    """What an update does: nothing, a rebuild (from an empty state), or replacing units of changed documents.

    A deletion does not force a rebuild here: units of deleted and modified documents are taken out before new ones are
    appended, and a dry run builds nothing.
    """
    if dry_run or changes.where("change_type <> 'UNCHANGED'").isEmpty():
        return "none"
    return "rebuild" if old.isEmpty() else "replace"


def to_reindex(changes: DataFrame) -> DataFrame:
    """(I6)"""
    return changes.where("change_type IN ('ADDED', 'MODIFIED')").select("document_id")


def updated_units(units: DataFrame, changes: DataFrame, fresh: DataFrame, key: str = "document_id") -> DataFrame:
    """Units with those of deleted and modified documents replaced by `fresh`."""
    gone = changes.where("change_type IN ('DELETED', 'MODIFIED')").select(key)
    return units.join(gone, key, "left_anti").unionByName(fresh.join(to_reindex(changes), key, "left_semi"))


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change_type) of listings (path, modified)."""
    both = old.select("path", F.col("modified").alias("before")).join(new.select("path", F.col("modified").alias("after")), "path", "full_outer")
    return both.select("path", _kind(F.col("before"), F.col("after")).alias("change_type"))


def _kind(before: Column, after: Column) -> Column:
    return F.when(before.isNull(), "ADDED").when(after.isNull(), "DELETED").when(before == after, "UNCHANGED").otherwise("MODIFIED")
