"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue, served in proportion to its target. The documents of a queue stand in an order shuffled by
the MD5 of their id; a queue may be served twice over (two epochs). Words are the packets: a word finishes at the
virtual time

    (words of its source up to and with it, earlier epochs included) / target of its source

and the mix is all words in the order of that time, cut at the total budget. A document's words in one epoch finish one
after the other, so a document needs its virtual start and finish only. Between two words all queues are served in
proportion to their targets, so `budget` words are reached at the virtual time budget / (sum of targets), one for the
whole budget, and that cut, one number for all sources, decides: a document that finishes before it is taken whole, one
that starts after it is left out, and the one of each queue that is being served is truncated at the cut. `mix` range-sorts
the whole by virtual time.

Defined results: null text has size 0 and takes nothing; a null source is a source of its own and comes last; empty
tables give empty results; documents with equal ids are ordered by size, and rows of equal id and size are
interchangeable; further columns are ignored by `fair_queue` and pass through `mix`. One row for each source reaches the
driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.storage import materialise

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
#: The shuffled order is cut into 16**3 equal ranges, each summed and ordered on its own.
RANGE_DIGITS = 3
#: A range of a queue with more rows (ids that repeat) is cut by id, size and salt.
RANGE_ROWS = 200_000
SALTS = 256
#: Up to so many sources, their targets (about 100 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> list[float]:
    """Targets of sources in order: `share` of all words by weight, at most `epochs` times a source's size, the excess
    going to the others by weight. The level is found by visiting sources from the smallest cap per weight."""
    own = [weights[i % len(weights)] for i in range(len(sizes))]
    caps = [epochs * s for s in sizes]
    by_level = sorted(range(len(sizes)), key=lambda i: (caps[i] / own[i], i))
    left, weight = share * sum(sizes), sum(own)
    level = 0.0
    for i in by_level:
        level = left / weight
        if level <= caps[i] / own[i]:
            break
        left -= caps[i]
        weight -= own[i]
    return [float(min(c, level * w)) for c, w in zip(caps, own, strict=True)]


def _positions(sized: DataFrame) -> DataFrame:
    """`sized` with `served_before`: the words of the queue before each row in its shuffled order."""
    ranged = sized.withColumn("part", F.substring("order_key", 1, RANGE_DIGITS))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("queue", "part").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    parts = materialise(parts.select("queue", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"), (F.col("rows") > RANGE_ROWS).alias("crowded")))
    placed = ranged.join(parts, ["queue", "part"])
    inside = Window.partitionBy("queue", "part").orderBy("order_key", "size").rowsBetween(Window.unboundedPreceding, 0)
    usual = placed.where("NOT crowded").withColumn("served_before", F.col("offset") + F.sum("size").over(inside) - F.col("size")).drop("part", "offset", "crowded")
    if parts.where("crowded").isEmpty():
        return usual
    unit = ["queue", "part", "order_key", "size", "salt"]
    crowded = placed.where("crowded").withColumn("salt", F.pmod("row", F.lit(SALTS)))
    earlier = Window.partitionBy("queue", "part").orderBy("order_key", "size", "salt").rowsBetween(Window.unboundedPreceding, -1)
    units = crowded.groupBy(*unit).agg(F.sum("size").alias("words")).withColumn("inside", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy(*unit).orderBy("row")) - 1
    split = crowded.join(units.select(*unit, "inside"), unit).withColumn("served_before", F.col("offset") + F.col("inside") + nth * F.col("size"))
    return usual.unionByName(split.select(usual.columns))


def fair_queue(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, budget: int | None = None) -> DataFrame:
    """One row per document: its id, size, source_size, target, taken, and virtual_start and virtual_finish of its first
    service; `budget` words in all (the sum of the targets, if not given). Text is read once, for its size, and takes no
    part in any shuffle."""
    return _queue(_sized(docs.select("doc_id", "source", "text")).drop("text"), weights, share, budget)


def _sized(docs: DataFrame) -> DataFrame:
    queue = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    order_key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.select("*", queue.alias("queue"), word_count(F.col("text")).alias("size"), order_key.alias("order_key"), F.monotonically_increasing_id().alias("row"))


def _queue(sized: DataFrame, weights: tuple[int, ...], share: float, budget: int | None) -> DataFrame:
    sized = materialise(sized)
    totals = sized.groupBy("source", "queue").agg(F.sum("size").alias("source_size")).collect()
    totals.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    quota = targets([r["source_size"] for r in totals], weights, share)
    cut = 1.0 if budget is None or budget >= sum(quota) else budget / sum(quota)
    sources = sized.sparkSession.createDataFrame([(r["queue"], r["source_size"], t) for r, t in zip(totals, quota, strict=True)], "queue string, source_size long, target double")
    if len(totals) <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    ended = _positions(sized).join(sources, "queue")
    at_cut = F.floor(F.lit(cut) * F.col("target") + 1e-6)  # words of the queue that finish by the cut
    takes = [F.greatest(F.lit(0), F.least(F.col("size"), at_cut - F.col("served_before") - e * F.col("source_size"))) for e in range(EPOCHS)]
    virtual = lambda words: F.when(F.col("target") > 0, words / F.col("target")).otherwise(F.lit(0.0))
    return ended.select(
        "doc_id", "source", "size", "source_size", "target",
        sum(takes[1:], takes[0]).cast("long").alias("taken"),
        virtual(F.col("served_before")).alias("virtual_start"),
        virtual(F.col("served_before") + F.col("size")).alias("virtual_finish"),
        "order_key", F.array(*takes).alias("take_by_epoch"), "row",
    )


def mix_order(queued: DataFrame) -> DataFrame:
    """The items that the mix takes, one per document and epoch, globally range-sorted by virtual finish time."""
    epoch = F.posexplode("take_by_epoch").alias("epoch", "words")
    items = queued.select("doc_id", "source", "size", "source_size", "target", "order_key", "virtual_finish", epoch).where("words > 0")
    finish = F.col("virtual_finish") + F.col("epoch") * F.col("source_size") / F.col("target")
    return items.withColumn("virtual_finish", finish).orderBy("virtual_finish", "source", "order_key", "size")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, budget: int | None = None) -> DataFrame:
    """The rows of `docs` that the mix takes, text and all, with size, source_size, target, taken (words, repeats counted)
    and virtual_finish; range-sorted by virtual_finish. Columns of these names give way."""
    given = materialise(_sized(docs.select(F.struct(*docs.columns).alias("whole"), "doc_id", "source", "text")).drop("text"))
    queued = _queue(given.drop("whole"), weights, share, budget).where("taken > 0").select("row", "size", "source_size", "target", "taken", "virtual_finish")
    made = ["size", "source_size", "target", "taken", "virtual_finish"]
    kept = [F.col("whole")[c].alias(c) for c in docs.columns if c not in made]
    return given.select("row", "whole").join(queued, "row").select(*kept, *made).sort("virtual_finish", "source", "doc_id")


def op4_mixing(spark, sf_dir):
    queued = fair_queue(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return queued.orderBy("virtual_finish", "source", "order_key").select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '')) AS order_key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
             row_number() OVER (ORDER BY source NULLS LAST) AS pos, sum(source_size) OVER () AS everything FROM s),
l AS (SELECT *, 2 * source_size / weight AS own_level,
             (1.5 * everything - coalesce(sum(2 * source_size) OVER v, 0))
               / (sum(weight) OVER () - coalesce(sum(weight) OVER v, 0)) AS level
      FROM w WINDOW v AS (ORDER BY 2 * source_size / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(level) FILTER (WHERE level <= own_level) AS level FROM (SELECT * FROM l ORDER BY own_level, pos)),
g AS (SELECT first(level ORDER BY own_level, pos) AS level FROM l WHERE level <= own_level),
t AS (SELECT source, source_size, least(2.0 * source_size, g.level * weight)::DOUBLE AS target FROM w, g),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target + 1e-6)::BIGINT AS quota,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.order_key, d.size ROWS UNBOUNDED PRECEDING) - d.size AS served
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       (greatest(0, least(size, quota - served)) + greatest(0, least(size, quota - served - source_size)))::BIGINT AS taken FROM c
"""
