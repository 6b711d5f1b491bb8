"""Benchmark decontamination: windows of item size, SimHash, multi-index Hamming blocks, exact verification.

Words are letter or digit runs, lower-cased; shingles are five words (a shorter text is one shingle). For each length
of benchmark items, windows of that many words slide over every document (a shorter document is one window). Two
windows or items compare by weighted shingles: the sum of the smaller multiplicities over the sum of the larger ones.
The contract is similarity 0.8 or more.

A window that is 0.8 similar to an item of its size has at least 0.8 / 1.8 of both shingle counts in common, so
windows with fewer benchmark shingles than that of the two together cannot qualify and are left out; the rest get a
SimHash of BITS bits from prefix sums of bit votes. At similarity 0.8 the two votes of a bit correlate by 0.8 / 0.9, so
a bit differs with probability arccos(0.889) / pi = 0.151; RADIUS is four deviations above what that gives. Fingerprints
within RADIUS bits differ by more than NEAR bits in at most RADIUS // (NEAR + 1) of their one-byte blocks, so at least
AGREE blocks lie within NEAR bits: a table per block, item length and byte lists the items near it, and the items that
AGREE blocks list are the candidates. That misses none within the radius, and lists about one unrelated item in a
thousand (in 64 bits the radius is too wide for any blocks to prune). Candidates within the radius are compared word by
word. An item of fewer words than a shingle is a single shingle and found by its hash.

The benchmark is taken ITEM_BLOCK items at a time (about 200 MB of tables on each executor at most); a larger one takes a
first pass that leaves out documents without any benchmark shingle (by a bitmap of bounded size), then a pass over the
rest for each block. Windows are taken PIECE at a time, so memory does not grow with the text. Documents are never
shuffled. Defined results: null or wordless texts take no part; items of null id are reported with null; items that are
repeated are reported each; of the windows of one document that match one item the most similar one, then the first,
is reported; equal rows give equal results; empty tables give empty results; extra columns are ignored, and pass
through `clean`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.bitmaps import bitmap_of
from lumenfold.storage import materialise

SHINGLE = 5
SIMILAR = 0.8
WORDS = 4
BITS = 64 * WORDS
BLOCKS = BITS // 8
RADIUS = 62
NEAR = 2
AGREE = BLOCKS - RADIUS // (NEAR + 1)
ITEM_BLOCK = 20_000
FILTER_BITS = 22
#: Windows that are fingerprinted at once, and pairs of window and item that are looked at at once.
PIECE, PAIRS = 2048, 1 << 17
WORD = re.compile(r"\w+")
_STEP = np.uint64(0x9E3779B97F4A7C15)  # the golden ratio's bits
_NEAR = np.array([[bin(a ^ b).count("1") <= NEAR for a in range(256)] for b in range(256)])


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingle_hashes(words: list[str], most: int = SHINGLE) -> np.ndarray:
    """One 64-bit hash for each shingle of `most` words, combined from hashes of words."""
    digest = xxhash.xxh64_intdigest
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    width = min(most, len(words))
    n = len(words) - width + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(width):
        mixed = (mixed ^ h[k : k + n]) * _STEP
        mixed ^= mixed >> np.uint64(29)
    return mixed


def shingles(words: list[str]) -> Counter[tuple[str, ...]]:
    width = min(SHINGLE, len(words))
    return Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def similarity(a: Counter, b: Counter) -> float:
    common = sum(min(n, b[s]) for s, n in a.items() if s in b)
    total = sum(a.values()) + sum(b.values()) - common
    return common / total if total else 0.0


def bits(hashes: np.ndarray) -> np.ndarray:
    """BITS bits of each hash, those after the first 64 of hashes mixed anew."""
    words = [hashes]
    for _ in range(WORDS - 1):
        mixed = (words[-1] ^ (words[-1] >> np.uint64(31))) * _STEP
        words.append(mixed ^ (mixed >> np.uint64(29)))
    return np.unpackbits(np.stack(words, 1).view(np.uint8), axis=1, bitorder="little")


def simhashes(hashes: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """Fingerprints (bytes) of the windows of `count` shingles that begin at `starts`: a bit is set by more than half."""
    sums = np.zeros((len(hashes) + 1, BITS), np.int32)
    np.cumsum(bits(hashes), axis=0, out=sums[1:])
    votes = sums[starts + count] - sums[starts]
    return np.packbits(2 * votes > count, axis=1, bitorder="little")


@dataclass
class Group:
    """Items of one length: ids, shingles, fingerprints, and for each block and byte the items near it, as bits."""

    keys: list
    grams: list[Counter]
    prints: np.ndarray
    tables: np.ndarray

    def listed(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of `prints` and items whose blocks agree as items within the radius do."""
        near = np.unpackbits(self.tables[np.arange(BLOCKS)[None, :], prints], axis=2, count=len(self.keys))
        return np.nonzero(near.sum(1, dtype=np.uint8) >= AGREE)


@dataclass
class Items:
    """A block of items: known shingles, items of SHINGLE words or more by length, and shorter ones by length and hash."""

    known: np.ndarray
    by_length: dict[int, Group]
    short: dict[int, dict[int, list]]

    def __post_init__(self) -> None:
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.known >> np.uint64(64 - FILTER_BITS)] = True


def prepare(items: list[tuple[int | None, str | None]]) -> Items:
    groups: dict[int, list[tuple[int | None, list[str]]]] = {}
    for key, text in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")):
        words = words_of(text)
        if words:
            groups.setdefault(len(words), []).append((key, words))
    known, by_length, short = [np.zeros(0, np.uint64)], {}, {}
    for length, found in sorted(groups.items()):
        hashes = [shingle_hashes(w) for _, w in found]
        if length < SHINGLE:
            for (key, _), h in zip(found, hashes, strict=True):
                short.setdefault(length, {}).setdefault(int(h[0]), []).append(key)
            continue
        known += hashes
        prints = np.concatenate([simhashes(h, np.zeros(1, int), len(h)) for h in hashes])
        tables = np.packbits(_NEAR[:, prints].transpose(2, 0, 1), axis=2)  # block, byte -> items
        by_length[length] = Group([k for k, _ in found], [shingles(w) for _, w in found], prints, tables)
    return Items(np.unique(np.concatenate(known)), by_length, short)


def matches(text: str | None, items: Items) -> list[tuple[int | None, int, int, float]]:
    """(item_id, first word, words, similarity) of each item that a window of `text` contains."""
    words = words_of(text)
    if not words:
        return []
    out: list[tuple] = []
    for length, known in items.short.items():
        if len(words) >= length:
            seen: set[int] = set()
            for at, h in enumerate(shingle_hashes(words, length).tolist()):
                if h in known and h not in seen:
                    seen.add(h)
                    out += [(key, at, length, 1.0) for key in known[h]]
    if len(items.known) and len(words) >= SHINGLE:
        out += _long_matches(words, items)
    return sorted(out, key=lambda x: (x[0] is None, x[0] or 0, *x[1:]))


def _long_matches(words: list[str], items: Items) -> list[tuple]:
    hashes = shingle_hashes(words)
    hit = items.filter[hashes >> np.uint64(64 - FILTER_BITS)]
    if not hit.any():
        return []
    at = np.nonzero(hit)[0]
    place = np.minimum(np.searchsorted(items.known, hashes[at]), len(items.known) - 1)
    hit[at] = items.known[place] == hashes[at]
    held = np.concatenate([[0], np.cumsum(hit)])
    out = []
    for length, group in items.by_length.items():
        size, wanted = min(length, len(words)), length - SHINGLE + 1
        count = size - SHINGLE + 1
        if min(count, wanted) < SIMILAR * max(count, wanted):
            continue
        common = held[count:] - held[:-count]
        starts = np.nonzero(common >= SIMILAR / (1 + SIMILAR) * (count + wanted) - 1e-9)[0]
        best: dict[int, tuple[float, int]] = {}
        for low, prints in _fingerprints(hashes, starts, count):
            step = max(1, PAIRS // len(group.keys))
            for k in range(0, len(prints), step):
                w, i = group.listed(prints[k : k + step])
                near = np.bitwise_count(prints[k + w] ^ group.prints[i]).sum(1, dtype=np.int64) <= RADIUS
                for w_, i_ in zip(w[near].tolist(), i[near].tolist(), strict=True):
                    start = int(low[k + w_])
                    s = similarity(shingles(words[start : start + size]), group.grams[i_])
                    if s >= SIMILAR and (i_ not in best or (-s, start) < (-best[i_][0], best[i_][1])):
                        best[i_] = (s, start)
        out += [(group.keys[i], start, size, s) for i, (s, start) in best.items()]
    return out


def _fingerprints(hashes: np.ndarray, starts: np.ndarray, count: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`starts` in pieces, with their fingerprints: windows close together share prefix sums."""
    k = 0
    while k < len(starts):
        end = int(np.searchsorted(starts, starts[k] + PIECE))
        some = starts[k:end]
        low, high = int(some[0]), int(some[-1]) + count
        yield some, simhashes(hashes[low:high], some - low, count)
        k = end


def item_blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The items, at most about ITEM_BLOCK at a time, split by a hash of id and text."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    parts = -(-rows.count() * 5 // (4 * ITEM_BLOCK))
    return [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) for k in range(parts)]


def _with_any_shingle(docs: DataFrame, benchmark: DataFrame, wanted: bool) -> DataFrame:
    """The rows of `docs` that hold a shingle of some item (or look so in a bitmap), or the others."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                words = words_of(text.as_py())
                hashes = shingle_hashes(words) if words else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.full(len(hashes), min(len(words), SHINGLE), np.int32))], names=["h", "width"])

    spelt = materialise(benchmark.select("text").mapInArrow(spell, "h long, width int").distinct())
    widths = sorted(r["width"] for r in spelt.select("width").distinct().collect())  # 1 to SHINGLE
    held = docs.sparkSession.sparkContext.broadcast(bitmap_of(spelt, "h"))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for text in batch.column(place):
                words = words_of(text.as_py())
                hit.append(any(len(words) >= w and bool(held.value.admits(shingle_hashes(words, w)).any()) for w in widths))
            yield batch.filter(pa.array([h == wanted for h in hit], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity) for each item that a document contains."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs, blocks = docs.select("doc_id", "text"), item_blocks(benchmark)
    if len(blocks) > 1:
        docs = materialise(_with_any_shingle(docs, benchmark, True))
    out = docs.sparkSession.createDataFrame([], f"doc_id {kind}, item_id long, first_word int, n_words int, similarity double")
    for block in blocks:
        held = docs.sparkSession.sparkContext.broadcast(prepare([(r["item_id"], r["text"]) for r in block.collect()]))  # about ITEM_BLOCK items

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            items = held.value
            for batch in batches:
                owner, found = [], []
                for i, text in enumerate(batch.column(1)):
                    for m in matches(text.as_py(), items):
                        owner.append(i)
                        found.append(m)
                cols = list(zip(*found, strict=True)) or [[], [], [], []]
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "item_id", "first_word", "n_words", "similarity"])

        found = docs.mapInArrow(run, out.schema)
        if len(blocks) > 1:
            found = materialise(found)
            held.unpersist()
        out = out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that contain no item."""
    place, blocks = docs.columns.index("text"), item_blocks(benchmark)
    left, rest = docs, None
    if len(blocks) > 1:
        left, rest = materialise(_with_any_shingle(docs, benchmark, True)), _with_any_shingle(docs, benchmark, False)
    for block in blocks:
        held = docs.sparkSession.sparkContext.broadcast(prepare([(r["item_id"], r["text"]) for r in block.collect()]))  # about ITEM_BLOCK items

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            items = held.value
            for batch in batches:
                yield batch.filter(pa.array([not matches(t.as_py(), items) for t in batch.column(place)], pa.bool_()))

        left = left.mapInArrow(run, docs.schema)
        if len(blocks) > 1:
            left = materialise(left)
            held.unpersist()
    return left if rest is None else rest.unionByName(left)


def op6_decontamination(spark, sf_dir):
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
