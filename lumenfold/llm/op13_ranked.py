"""Ranked lexical search: impact-ordered postings, score at a time.

A posting's impact is the integer (1000000000 * tf) div (1000 * tf + 8 * m), m growing with the document's length; an item's
score of a document is the sum of weight * impact over the item's terms. One pass over the texts leaves for every document
its length and the frequencies of those terms that any item has (the forward table); counts over that table give the
corpus's statistics. The second pass reads the forward table. A task takes its documents in shards of SHARD_POSTINGS
postings, orders the postings of each term by impact, equal impacts together, and answers every item from the largest
contributions (weight * impact) down:

* a level adds all groups of impact whose contribution is at least a falling limit to the documents' sums;
* what is still to come is bounded, for any document, by the sum over terms of the next group's contribution;
* the k-th largest sum so far, or the k-th score of the task's earlier shards, is a score that the result reaches. The item
  is done when documents not met cannot reach it and few of the others can (FEW); until then levels go on, to the end
  if need be. Those few get their complete scores from the forward table.

Each task hands over its k best documents an item, which are ranked in two steps, so the number of tasks doesn't
make a hot group. Items are taken in blocks of about BLOCK_PAIRS pairs of item and term, whose vocabulary and terms go to
the tasks in a broadcast (some 100 bytes a pair); one block after the other is answered and written.

Defined results: an item is an item_id, the null one too, and its terms are those of all its rows; items without terms,
and null or empty texts, have no rows; a document without terms is not counted; rows that repeat a doc_id are documents
of their own, with equal rows next to each other; a null doc_id comes last among equal scores; empty tables give no
rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.storage import materialise

TOP = 10
BLOCK_PAIRS = 500_000
SHARD_POSTINGS = 2_000_000
SHARD_ROWS = 1 << 17
#: Documents that may be completed at the end, instead of adding further levels.
FEW = 256
#: A level goes down to this share of the largest contribution left.
LEVEL = 0.85
#: Groups into which the tasks' results of an item are dealt before they are ranked together.
SALTS = 64
#: Fixed values of the score.
IMPACT, SATURATION, LENGTH = 1_000_000_000, 1_000, 8
BASE, BY_LENGTH = 10, 90

#: Bytes to bytes: letters lower-cased, digits and bytes beyond ASCII kept, the rest to spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return text.translate(_FOLD).split()


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
            found = sorted(set(terms_of(text or b"")))
            yield pa.RecordBatch.from_arrays([pa.array([batch.column("item_id")[i].as_py()] * len(found), batch.column("item_id").type), pa.array(found, pa.binary()).cast(pa.string())], names=["item_id", "term"])


def _forward(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    vocabulary = held.value[0]
    for batch in batches:
        lengths, ends, terms, counts = [], [0], [], []
        for text in batch.column("text").cast(pa.binary()):
            all_terms = terms_of(text.as_py() or b"")
            lengths.append(len(all_terms))
            tally = Counter(all_terms)
            small, large = (tally, vocabulary) if len(tally) < len(vocabulary) else (vocabulary, tally)
            for term in small:
                if term in large:
                    terms.append(vocabulary[term])
                    counts.append(tally[term])
            ends.append(len(terms))
        offsets = pa.array(ends, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (counts, pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])


@dataclass
class Statistics:
    documents: int
    all_terms: int

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))

    def impacts(self, n: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Of postings, by document length and frequency."""
        if 90 * int(n.max(initial=0)) * self.documents < 1 << 63:
            m = BASE + (BY_LENGTH * n * self.documents) // max(self.all_terms, 1)
        else:
            m = np.array([BASE + (BY_LENGTH * int(v) * self.documents) // self.all_terms for v in n], np.int64)
        return (IMPACT * tf) // (SATURATION * tf + LENGTH * m)


class Shard:
    """The documents of a part of the forward table, by row, and their postings by term and falling impact."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, statistics: Statistics):
        self.ids = ids
        self.start = np.r_[0, np.cumsum(sizes)]
        self.terms = terms
        rows = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        self.impacts = statistics.impacts(np.repeat(n, sizes), counts)
        order = np.lexsort((-self.impacts, terms))
        self.rows, self.fallen = rows[order], -self.impacts[order]  # negated, so that searchsorted finds groups
        self.present, first = np.unique(terms[order], return_index=True)
        self.bounds = np.r_[first, len(order)]

    def complete(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of rows; `weights` by term, 0 where the item lacks it."""
        sizes = self.start[rows + 1] - self.start[rows]
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.start[rows], sizes)
        out = np.zeros(len(rows), np.int64)
        np.add.at(out, np.repeat(np.arange(len(rows)), sizes), weights[self.terms[at]] * self.impacts[at])
        return out

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, reached: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, scores, postings added): all rows that may be among the k best and score at least `reached`; weights by term."""
        where = np.searchsorted(self.present, terms)
        here = (where < len(self.present)) & (self.present[np.minimum(where, len(self.present) - 1)] == terms) & (weights[terms] > 0) if len(self.present) else np.zeros(len(terms), bool)
        lists = [(int(weights[t]), self.rows[a:b], self.fallen[a:b]) for t, a, b in zip(terms[here], self.bounds[where[here]], self.bounds[where[here] + 1], strict=True)]
        at, sums, added = [0] * len(lists), np.zeros(len(self.ids), np.int64), 0
        while True:
            ahead = [-w * int(fallen[p]) if p < len(fallen) else 0 for (w, _, fallen), p in zip(lists, at, strict=True)]
            left = sum(ahead)  # more than this no document can still get
            if added and len(sums) >= k:
                reached = max(reached, int(np.partition(sums, len(sums) - k)[len(sums) - k]))
            if not left:
                rows = np.flatnonzero((sums > 0) & (sums >= reached))
                return rows, sums[rows], added
            if left < reached:
                rows = np.flatnonzero(sums + left >= reached)
                if len(rows) <= FEW:
                    scores = self.complete(rows, weights)
                    good = scores >= reached
                    return rows[good], scores[good], added
            limit = max(1, int(LEVEL * max(ahead)))
            for j, (w, rows, fallen) in enumerate(lists):
                end = int(np.searchsorted(fallen, -(-(-limit // w)), "right"))  # impacts of at least limit / w
                if end > at[j]:
                    sums[rows[at[j] : end]] += -w * fallen[at[j] : end]
                    added += end - at[j]
                    at[j] = end


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: larger score, then smaller id."""
    return np.lexsort((ids, -scores))[:k]


#: Stands for a null doc_id, after every other.
NO_ID = np.iinfo(np.int64).max


def _search(batches: Iterator[pa.RecordBatch], held, df: dict[int, int], statistics: Statistics, k: int) -> Iterator[pa.RecordBatch]:
    items = held.value[1]
    weights = np.zeros(len(held.value[0]), np.int64)
    for term, n in df.items():
        weights[term] = statistics.weight(n)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items]
    own = np.zeros_like(weights)
    for shard in _shards(batches, statistics):
        for j, terms in enumerate(items):
            ids, scores = found[j]
            own[terms] = weights[terms]
            rows, more, _ = shard.search(terms, own, k, int(scores[-1]) if len(scores) == k else 1)
            own[terms] = 0
            if len(rows):
                ids, scores = np.r_[ids, shard.ids[rows]], np.r_[scores, more]
                best = _best(ids, scores, k)
                found[j] = ids[best], scores[best]
    ids = np.concatenate([f[0] for f in found] or [np.zeros(0, np.int64)])
    yield pa.RecordBatch.from_pydict(
        {
            "item": pa.array(np.repeat(np.arange(len(items)), [len(f[0]) for f in found]), pa.int32()),
            "doc_id": pa.array(ids, pa.int64(), mask=ids == NO_ID),
            "score": pa.array(np.concatenate([f[1] for f in found] or [np.zeros(0, np.int64)]), pa.int64()),
        }
    )


def _shards(batches: Iterator[pa.RecordBatch], statistics: Statistics) -> Iterator[Shard]:
    kept: list[tuple[np.ndarray, ...]] = []
    rows = postings = 0
    for batch in batches:
        ids = batch.column("doc_id").cast(pa.int64())
        sizes = batch.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        kept.append((ids.fill_null(NO_ID).to_numpy(zero_copy_only=False), batch.column("n").to_numpy(), sizes, batch.column("terms").flatten().to_numpy(), batch.column("counts").flatten().to_numpy()))
        rows, postings = rows + len(sizes), postings + int(sizes.sum())
        if rows >= SHARD_ROWS or postings >= SHARD_POSTINGS:
            yield Shard(*map(np.concatenate, zip(*kept, strict=True)), statistics)
            kept, rows, postings = [], 0, 0
    if postings:
        yield Shard(*map(np.concatenate, zip(*kept, strict=True)), statistics)


def _block(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(item_id, doc_id, score) of one block: the k best of every task and item."""
    spark = docs.sparkSession
    told = pairs.toArrow()
    terms = {t: i for i, t in enumerate(sorted(set(told.column("term").cast(pa.binary()).to_pylist())))}
    by_item: dict[object, list[int]] = {}
    for item, term in zip(told.column("item_id").to_pylist(), told.column("term").cast(pa.binary()).to_pylist(), strict=True):
        by_item.setdefault(item, []).append(terms[term])
    held = spark.sparkContext.broadcast((terms, [np.array(sorted(t), np.int64) for t in by_item.values()]))
    forward = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: _forward(b, held), "doc_id long, n long, terms array<int>, counts array<long>"))
    total = forward.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("terms")).first()
    statistics = Statistics(total["documents"], total["terms"] or 0)
    df = {r["term"]: r["count"] for r in forward.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}  # at most the block's vocabulary
    best = forward.mapInArrow(lambda b: _search(b, held, df, statistics, k), "item int, doc_id long, score long")
    names = spark.createDataFrame(list(enumerate(by_item)), f"item int, item_id {dict(pairs.dtypes)['item_id']}")
    best = materialise(best.join(F.broadcast(names), "item").select("item_id", "doc_id", "score"))  # at most a block's items
    held.unpersist()
    return best


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents with a score above 0 of every item."""
    kind = dict(items.dtypes)["item_id"]
    pairs = materialise(items.select("item_id", "text").mapInArrow(_item_terms, f"item_id {kind}, term string").distinct())
    blocks = -(-pairs.count() // block_pairs)
    block = F.pmod(F.xxhash64("item_id"), F.lit(max(blocks, 1)))
    found = [_block(docs, pairs.where(block == b), k) for b in range(blocks)]
    if not found:
        return pairs.selectExpr("item_id", "1 AS rank", "0L AS doc_id", "0L AS score").limit(0)
    best = found[0]
    for other in found[1:]:
        best = best.unionByName(other)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salt = F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS))
    some = best.withColumn("salt", salt).withColumn("nth", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).where(F.col("nth") <= k)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return some.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_ranked(spark, sf_dir):
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH q AS MATERIALIZED (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce({_TERMS}, []) AS terms FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS all_terms FROM d),
p AS MATERIALIZED (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term),
m AS (SELECT row, doc_id, 100 - 90 + (90 * len(terms) * n_docs) // all_terms AS m FROM d, s),
x AS (SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (row) GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0) WHERE rank <= {TOP}
"""
