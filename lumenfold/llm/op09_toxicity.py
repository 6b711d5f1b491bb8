"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are all words of a bounded sample of the labelled rows of both classes (SAMPLE_ROWS rows, in the order of a hash of
their id), of which EXAMPLES, again by hash, are the examples of the index. A document's vector holds every known term, weighted

    (1 + ln tf) * idf * (max(0, G - 2 ln(terms)) + SMOOTH)

with idf from counts over all documents and G the two-sided log-likelihood ratio of term and class in the sample,
beyond what chance gives among so many terms: a term that both classes use alike weighs little, one that marks either
class weighs much. Without G the nearest examples share topic and language, not toxicity.

The examples stand in a block-max inverted index: posting lists cut into blocks of BLOCK examples, each with its
largest weight. A query adds up its short lists, bounds every block by the largest sum so far and the block maxima of
its long lists, visits blocks from the highest bound on, and stops when no bound reaches its K-th similarity, so the K
nearest are exact. They vote with weight
1 / (1 - cosine + SOFTEN), against one pseudo-vote of the base rate, and an isotonic map fitted on the examples'
leave-one-out votes turns the vote into a calibrated score. The nearest examples and the terms shared are evidence.

Defined results: a text without known terms (a null or empty one too) has no neighbours and scores the rate of toxic
rows among examples without terms, smoothed by the base rate; a null doc_id counts as not held out and is not learned
from; of a labelled id that is repeated every row may be sampled, with the largest label; equal rows give equal
results; without labels every score is 0; empty tables give empty results; extra columns are ignored, and pass through
`keep`.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.sampling import hashed_sample
from lumenfold.storage import materialise

SAMPLE_ROWS = 4096
#: Of these rows, so many stand in the index; the others only help to weigh terms.
EXAMPLES = 2048
SMOOTH = 0.01
NEAREST = 25
SOFTEN = 0.05
BLOCK = 32
#: Blocks that are visited first, before others are ruled out.
FIRST_BLOCKS = 8
#: A list is long that holds more than 1 / LONG of the examples.
LONG = 4
#: Vectors whose results a worker remembers, and documents that a task hands on at once.
REMEMBERED = 50_000
HANDED = 512
WORD = re.compile(r"\w+")


def terms_of(text: str | None) -> Counter[str]:
    return Counter(WORD.findall((text or "").lower()))


def known_terms(text: str | None, vocabulary: dict[str, int]) -> list[tuple[int, int]]:
    """(term, times) of the known terms of a text, in order."""
    find = vocabulary.get
    return sorted((t, n) for t, n in ((find(w), n) for w, n in terms_of(text).items()) if t is not None)


class Index:
    """Examples by their vectors, in blocks of BLOCK; those with the same heaviest frequent terms stand together.

    A term's posting list is short (kept as places and weights) or long, of more than 1 / LONG of the examples (kept by
    block, with the block's largest weight)."""

    def __init__(self, ids: list, labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], size: int) -> None:
        self.count, self.blocks = len(ids), -(-len(ids) // BLOCK)
        length = np.bincount(np.concatenate([t for t, _ in vectors]) if vectors else np.zeros(0, np.int64), minlength=size)
        long = length > self.count / LONG

        def profile(i: int) -> tuple:
            terms, weights = vectors[i]
            some = long[terms]
            return (*terms[some][np.argsort(-weights[some], kind="stable")[:3]].tolist(), -1, i)

        order = sorted(range(len(ids)), key=profile)
        self.ids, self.labels, self.vectors = [ids[i] for i in order], np.asarray(labels, float)[order], [vectors[i] for i in order]
        place = np.repeat(np.arange(self.count), [len(t) for t, _ in self.vectors])
        terms, weights = (np.concatenate([v[k] for v in self.vectors]) if self.count else np.zeros(0, kind) for k, kind in enumerate((np.int64, float)))
        self.row = np.where(long, np.cumsum(long) - 1, -1)
        self.long = np.zeros((int(long.sum()), self.blocks, BLOCK))
        some = long[terms]
        self.long[self.row[terms[some]], place[some] // BLOCK, place[some] % BLOCK] = weights[some]
        self.most = self.long.max(2, initial=0.0)
        by = np.nonzero(~some)[0][np.argsort(terms[~some], kind="stable")]
        self.place, self.weight = place[by].astype(np.intp), weights[by]
        self.post = np.concatenate([[0], np.cumsum(np.where(long, 0, length))])

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEAREST, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples, ties to the earlier one; only those that share a term."""
        if not len(terms) or not self.count:
            return np.zeros(0, np.int64), np.zeros(0)
        low, times = self.post[terms], self.post[terms + 1] - self.post[terms]
        at = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
        sums = np.bincount(self.place[at], np.repeat(weights, times) * self.weight[at], self.blocks * BLOCK).astype(float).reshape(-1, BLOCK)
        spread = self.row[terms] >= 0
        rows, shares = self.row[terms[spread]], weights[spread]
        bound = sums.max(1) + shares @ self.most[rows]
        left = np.nonzero(bound > 0)[0]
        left = left[np.argsort(-bound[left], kind="stable")]
        places, scores, least, width = np.zeros(0, np.int64), np.zeros(0), 0.0, FIRST_BLOCKS
        while len(left):  # the blocks of the highest bounds, then those whose bounds still reach the k-th similarity
            chosen = left[:width]
            found = sums[chosen]
            for row, w in zip(rows.tolist(), shares.tolist(), strict=True):
                found += w * self.long[row][chosen]
            found = np.round(found, 9).ravel()
            own = (chosen[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            hit = np.nonzero((found > 0) & (found >= least) & (own != without))[0]
            places, scores = np.concatenate([places, own[hit]]), np.concatenate([scores, found[hit]])
            if len(scores) > k:
                least = np.partition(scores, -k)[-k]
                some = scores >= least
                places, scores = places[some], scores[some]
            left, width = left[width:], len(left)
            left = left[bound[left] >= least - 1e-8]
        best = np.lexsort((places, -scores))[:k]
        return places[best], scores[best]


@dataclass
class Model:
    vocabulary: dict[str, int]
    weight: np.ndarray
    index: Index
    rate: float
    base: float
    knots: tuple[np.ndarray, np.ndarray]

    def weigh(self, terms: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = (1 + np.log(times)) * self.weight[terms]
        norm = math.sqrt(float(raw @ raw))
        return (terms, raw / norm) if norm else (terms[:0], raw[:0])

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        weights = 1 / (1 - np.minimum(cosines, 1.0) + SOFTEN)
        return float((self.rate + weights @ self.index.labels[places]) / (1 + weights.sum()))

    def score(self, terms: np.ndarray, weights: np.ndarray) -> tuple[float, float, str]:
        """Score, vote and evidence of a vector."""
        places, cosines = self.index.nearest(terms, weights)
        if not len(places):
            return self.base, self.base, ""
        vote = self.vote(places, cosines)
        near = "; ".join(f"{self.index.ids[i]} ({self.index.labels[i]:.0f}, {s:.3f})" for i, s in zip(places[:3].tolist(), cosines[:3].tolist(), strict=True))
        heavy = terms[np.argsort(-weights, kind="stable")[:8]].tolist()
        return min(1.0, max(0.0, float(np.interp(vote, *self.knots)))), vote, f"{near}: {' '.join(self.words[t] for t in heavy)}"

    @property
    def words(self) -> list[str]:
        if "_words" not in self.__dict__:
            self.__dict__["_words"] = sorted(self.vocabulary, key=self.vocabulary.get)
        return self.__dict__["_words"]


def isotonic(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Monotone rate of toxic labels by vote, from pooled adjacent groups with one pseudo-observation each."""
    if not len(votes):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    order = np.argsort(votes, kind="stable")
    groups: list[list[float]] = []  # labels, rows, votes
    for part in np.array_split(order, max(1, min(100, len(order) // 10))):
        groups.append([float(labels[part].sum()), float(len(part)), float(votes[part].sum())])
        while len(groups) > 1 and groups[-2][0] / groups[-2][1] >= groups[-1][0] / groups[-1][1]:
            last = groups.pop()
            groups[-1] = [a + b for a, b in zip(groups[-1], last, strict=True)]
    x = np.array([v / n for _, n, v in groups])
    y = np.array([(t + v / n) / (n + 1) for t, n, v in groups])
    return np.concatenate([[0.0], x, [1.0]]), np.concatenate([[0.0], np.maximum.accumulate(y), [1.0]])


def association(n: np.ndarray, toxic: np.ndarray, rows: float, all_toxic: float) -> np.ndarray:
    """G of term and class: n of `rows` examples hold the term, `toxic` of them of `all_toxic` toxic ones."""
    if not 0 < all_toxic < rows:
        return np.zeros(len(n))

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-300) / np.maximum(expected, 1e-300)), 0.0)

    p = all_toxic / rows
    with_term = part(toxic, n * p) + part(n - toxic, n * (1 - p))
    without = part(all_toxic - toxic, (rows - n) * p) + part(rows - all_toxic - n + toxic, (rows - n) * (1 - p))
    return np.maximum(2 * (with_term + without), 0.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def document_counts(docs: DataFrame, vocabulary: dict[str, int]) -> np.ndarray:
    """In how many documents each term occurs. What reaches the driver is one number a term."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(held.value), np.int64)
        for batch in batches:
            for text in batch.column(0):
                find = held.value.get
                counts[[t for t in map(find, set(WORD.findall((text.as_py() or "").lower()))) if t is not None]] += 1
        seen = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[seen])], names=["term", "n"])

    found = docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    held.unpersist()
    out = np.zeros(len(vocabulary))
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return out


def examples(docs: DataFrame, labels: DataFrame) -> pa.Table:
    """(doc_id, key, toxic, terms, times) of at most SAMPLE_ROWS labelled rows, in order."""
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    chosen = hashed_sample(usable.select("doc_id", "toxic"), SAMPLE_ROWS, "doc_id", "toxic").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = materialise(chosen)  # at most SAMPLE_ROWS small rows, so the broadcast below is bounded
    kind = docs.schema["doc_id"].dataType.simpleString()

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(2)):
                counts = terms_of(text.as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + 1], batch.column(1)[i : i + 1], pa.array([list(counts.keys())], pa.list_(pa.string())), pa.array([list(counts.values())], pa.list_(pa.int32()))], names=["doc_id", "toxic", "terms", "times"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    spelt = materialise(rows.mapInArrow(spell, f"doc_id {kind}, toxic int, terms array<string>, times array<int>").withColumn("key", F.xxhash64(F.array_sort(F.arrays_zip("terms", "times")))))
    return hashed_sample(spelt, SAMPLE_ROWS, "doc_id", "key").select("doc_id", "key", "toxic", "terms", "times").toArrow().sort_by([("doc_id", "ascending"), ("key", "ascending")])


def vectors_of(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(doc_id, terms, times): the known terms of every document, written once."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, max(1, batch.num_rows), HANDED):
                some = [np.array(known_terms(t.as_py(), held.value), np.int32).reshape(-1, 2) for t in batch.column(1)[k : k + HANDED]]
                first = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in some])]).astype(np.int32))
                both = np.concatenate(some) if some else np.zeros((0, 2), np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[k : k + HANDED], *(pa.ListArray.from_arrays(first, pa.array(np.ascontiguousarray(both[:, c]))) for c in (0, 1))], names=["doc_id", "terms", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return materialise(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, terms array<int>, times array<int>"))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    return _model(examples(docs, labels), lambda vocabulary: document_counts(docs, vocabulary), docs.count())


def _model(rows: pa.Table, document_frequency, documents: int) -> Model:
    ids, toxic = rows.column("doc_id").to_pylist(), rows.column("toxic").to_numpy().astype(float)
    spoken, times = (rows.column(c).combine_chunks() if rows.num_rows else pa.array([], pa.list_(kind)) for c, kind in (("terms", pa.string()), ("times", pa.int32())))
    words = spoken.flatten().unique().sort()
    terms, times = pc.index_in(spoken.flatten(), words).to_numpy(zero_copy_only=False).astype(np.int64), times.flatten().to_numpy(zero_copy_only=False).astype(float)
    first = np.concatenate([[0], np.cumsum(pc.list_value_length(spoken).to_numpy(zero_copy_only=False))]).astype(np.int64)
    vocabulary, size = {t: i for i, t in enumerate(words.to_pylist())}, len(words)
    n = np.bincount(terms, minlength=size)
    n1 = np.bincount(terms, np.repeat(toxic, np.diff(first)), minlength=size)
    idf = np.log((1 + documents) / (1 + document_frequency(vocabulary))) + 1
    rate = float(toxic.mean()) if len(toxic) else 0.0
    bare = toxic[np.diff(first) == 0]
    beyond = np.maximum(association(n, n1, float(len(ids)), float(toxic.sum())) - 2 * math.log(max(1, size)), 0.0)
    model = Model(vocabulary, idf * (beyond + SMOOTH), Index([], np.zeros(0), [], size), rate, float((bare.sum() + rate) / (len(bare) + 1)), isotonic(np.zeros(0), np.zeros(0)))
    vectors = []
    marked = np.nonzero(np.diff(first))[0]
    marked = np.sort(marked[np.argsort([xxhash.xxh64_intdigest(f"{ids[i]}:{i}") for i in marked.tolist()])[:EXAMPLES]])
    for i in marked.tolist():
        own = np.arange(first[i], first[i + 1])
        own = own[np.argsort(terms[own])]
        vectors.append(model.weigh(terms[own], times[own]))
    index = model.index = Index([ids[i] for i in marked], toxic[marked], vectors, size)
    votes = [model.vote(*index.nearest(*v, without=i)) for i, v in enumerate(index.vectors)]
    model.knots = isotonic(np.array(votes), index.labels)
    index.vectors = []
    return model


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, predicted, vote, evidence) of every row; evidence names the three nearest examples. Every text is
    read once, for its terms."""
    written: list[DataFrame] = []

    def frequency(vocabulary: dict[str, int]) -> np.ndarray:
        written.append(vectors_of(docs, vocabulary))
        found = written[0].select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).toArrow()
        out = np.zeros(len(vocabulary))
        out[found.column("term").to_numpy()] = found.column("n").to_numpy()
        return out

    model = _model(examples(docs, labels), frequency, docs.count())
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(held.value)
        for batch in batches:
            out = []
            terms, times = batch.column(1), batch.column(2)
            first, all_terms, all_times = terms.offsets.to_numpy().tolist(), terms.values.to_numpy(), times.values.to_numpy()
            for a, z in zip(first, first[1:], strict=False):
                out.append(known.of_vector(all_terms[a:z], all_times[a:z]))
            scores = [s for s, _, _ in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array([v for _, v, _ in out], pa.float64()), pa.array([e for _, _, e in out], pa.string())], names=["doc_id", "score", "predicted", "vote", "evidence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return written[0].mapInArrow(run, f"doc_id {kind}, score double, predicted int, vote double, evidence string")


class Known:
    """A model that remembers the results of up to REMEMBERED vectors, so that copies cost little."""

    def __init__(self, model: Model) -> None:
        self.model, self.held = model, {}

    def __call__(self, text: str | None) -> tuple[float, float, str]:
        held = np.array(known_terms(text, self.model.vocabulary), np.int32).reshape(-1, 2)
        return self.of_vector(held[:, 0], held[:, 1])

    def of_vector(self, terms: np.ndarray, times: np.ndarray) -> tuple[float, float, str]:
        key = xxhash.xxh3_128_digest(np.concatenate([terms, times]).tobytes())
        if key not in self.held:
            if len(self.held) >= REMEMBERED:
                self.held.clear()
            self.held[key] = self.model.score(*self.model.weigh(terms.astype(np.int64), times.astype(float)))
        return self.held[key]


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that score below 0.5, as they are."""
    held = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(held.value)
        for batch in batches:
            yield batch.filter(pa.array([known(t.as_py())[0] < 0.5 for t in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark, sf_dir):
    found = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "vote", "evidence")
