"""Streams: index updates from arriving files, windows over events, answers cut into pieces."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenfold.functions.text import content_hash
from lumenfold.operators import incremental
from lumenfold.operators.chunking import token_chunks
from lumenfold.sources.buckets import BucketedIndex
from lumenfold.sources.store import Store
from lumenfold.storage import materialise


def update_index(store: Store, arrived: DataFrame, order: str = "version") -> None:
    """Take documents (document_id, text) into the store: changed ones replace their units, others are added. The last row
    of a document in the batch counts: the one of the largest `order` column, if there is one, then the one that comes
    last in the batch. Units go before the state that names them, so a batch that breaks off between is taken again.
    Running a batch twice leaves the same index. (R7)"""
    place = F.struct(*([order] if order in arrived.columns else []), "_at")
    rows = materialise(arrived.withColumn("_at", F.monotonically_increasing_id()).groupBy("document_id").agg(F.max_by("text", place).alias("text")))
    units = token_chunks(rows, key="document_id").select(F.col("chunk_id").alias("id"), "document_id", F.col("chunk").alias("text"))
    names = units.groupBy("document_id").agg(F.array_sort(F.collect_list("id")).alias("units"))
    none = F.array().cast("array<string>")
    new = rows.join(names, "document_id", "left").select("document_id", content_hash(F.col("text")).alias("content_hash"), F.coalesce("units", none).alias("units"))
    old = store.read("state")
    if old is None:
        store.write("text_units", units)
        store.write("state", new)
        return
    changes = incremental.classify(old, new, check_deleted=False)
    store.write("text_units", incremental.updated_units(store.read("text_units"), changes, units))
    store.write("state", old.join(new, "document_id", "left_anti").unionByName(new))


def follow(spark: SparkSession, source: str, schema: str, store: Store, checkpoint: str, take: Callable[[DataFrame], DataFrame] | None = None, files_a_batch: int = 100) -> StreamingQuery:
    """Feed Parquet files that arrive in `source` to the index, as far as there are any."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    batch = lambda rows, _: update_index(store, take(rows) if take else rows)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_buckets(spark: SparkSession, source: str, schema: str, index: BucketedIndex, checkpoint: str, files_a_batch: int = 100) -> StreamingQuery:
    """Feed Parquet files of (document_id, text) to a bucketed index. The last row of a document is that of the newest file,
    then of the later path, then of the later row in it. (R7)"""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    version = F.struct(F.col("_metadata.file_modification_time"), F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias("version")
    stream = stream.select("document_id", "text", version)
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    return stream.writeStream.foreachBatch(lambda rows, batch: index.update(rows, batch=(name, batch)) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_usage(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(start, event_type, n, total) of event-time windows; works on batches and, with the watermark, on streams."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def buffered(tokens: DataFrame, size: int = 10, by: str = "answer_id", order: str = "pos", piece: str = "token") -> DataFrame:
    """(answer, flush, chunk): tokens are held until `size` characters are there, the rest comes last.

    A flush empties the buffer, so it depends on the one before: an accumulator walks each answer's tokens.
    """
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, piece))), lambda s: s[piece])
    start = F.struct(F.lit("").alias("held"), F.array().cast("array<string>").alias("out"))

    def step(acc, t):
        held = F.concat(acc["held"], t)
        full = F.length(held) >= size
        return F.struct(F.when(full, "").otherwise(held).alias("held"), F.when(full, F.concat(acc["out"], F.array(held))).otherwise(acc["out"]).alias("out"))

    pieces = F.aggregate("t", start, step, lambda acc: F.when(acc["held"] != "", F.concat(acc["out"], F.array(acc["held"]))).otherwise(acc["out"]))
    return tokens.groupBy(by).agg(listed.alias("t")).select(by, F.posexplode(pieces).alias("flush", "chunk"))


#: Kinds of pieces of a streamed answer.
STREAM_KINDS = ("start", "progress", "result", "complete", "text", "end")


def answer_stream(results: DataFrame, answer: str) -> DataFrame:
    """(seq, kind, content): the pieces of a streamed search: start, progress and result for each hit, complete, the words of
    the answer, end. results: (rank, id). (R1, R5)"""
    spark = results.sparkSession
    n = results.count()  # a ranked list
    hits = results.select((F.col("rank") * 2 - 1).alias("seq"), F.lit("progress").alias("kind"), F.concat(F.col("rank").cast("string"), F.lit(f"/{n}")).alias("content")).unionByName(results.select((F.col("rank") * 2).alias("seq"), F.lit("result").alias("kind"), F.col("id").cast("string").alias("content")))
    words = answer.split()
    rest = [(0, "start", ""), (2 * n + 1, "complete", str(n)), *((2 * n + 2 + k, "text", w) for k, w in enumerate(words)), (2 * n + 2 + len(words), "end", "")]
    return hits.unionByName(spark.createDataFrame(rest, "seq int, kind string, content string"))


def first_answers(lists: DataFrame, by: str = "engine", order: str = "finished") -> DataFrame:
    """Results in the order of completion."""
    return lists.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(order)))
