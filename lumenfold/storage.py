"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import contextvars
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_passing: contextvars.ContextVar[list[tuple[SparkSession, str]] | None] = contextvars.ContextVar("passing", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where nothing is set a temporary one in local runs; elsewhere executors would
    each write to a disk of their own, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="lumenfold-"))
    return context._jsc.sc().getCheckpointDir().get()


def drop_table(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        fs, target = _located(spark, path)
        folder = target.getParent() if target.getName() == _INSIDE else target
        fs.delete(folder, True)
        fs.cancelDeleteOnExit(folder)


def _located(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


#: A table's folder is made, and marked to go, before Spark writes into it.
_INSIDE = "rows"


def scratch(spark: SparkSession) -> str:
    """The path of a new folder that all executors share. It goes when the driver's process ends, stopped sessions or
    not, or with the `passing_tables` it is made in."""
    fs, folder = _located(spark, f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}")
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    path = f"{folder.toString()}/{_INSIDE}"
    passing = _passing.get()
    if passing is not None:
        passing.append((spark, path))
    return path


@contextlib.contextmanager
def passing_tables() -> Iterator[None]:
    """Tables that this thread materialises inside go when it ends, so what is computed from them must have been written
    by then. Other threads' tables stay."""
    mine: list[tuple[SparkSession, str]] = []
    token = _passing.set(mine)
    try:
        yield
    finally:
        _passing.reset(token)
        for spark, path in mine:
            drop_table(spark, path)


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back.

    The result has no lineage behind it and survives the loss of any executor. Tables go when the session's
    process ends.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """`materialise` with the rows in buckets by `key`, as many as a shuffle has parts, so that a join on `key` shuffles the
    other side only. The table's name is gone at once; its files go like those of others."""
    if df.schema[key].dataType.typeName() in ("struct", "array", "map"):
        return materialise(df)  # no buckets by these
    spark, name = df.sparkSession, f"dealt_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(parts, key).write.bucketBy(parts, key).option("path", scratch(spark)).saveAsTable(name, format="parquet")
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table
