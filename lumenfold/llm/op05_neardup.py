"""Near copies by SimHash: vantage-point trees over fingerprints.

A document's fingerprint has 64 bits; two fingerprints link when at most RADIUS bits differ. In the full 64-bit space
distances of unrelated fingerprints crowd about 32, where a ball of radius 4 crosses nearly every boundary of a
vantage-point tree and nothing is pruned. So the trees stand on projections: if two fingerprints differ in at most 4
bits, then in at least one of four 16-bit quarters they differ in at most 4 // 4 = 1. The Hamming distance of a
quarter is a metric, each quarter has a tree of its own, and the triangle bound there uses radius 1. All 65,536 points
of that space are sorted into the tree beforehand, so the tree is a table of constant size that does not depend on
the data.

A leaf is a shard. A fingerprint has one home leaf in each tree and also visits the leaves that its ball overlaps,
of those only the later ones, since a pair needs to meet once. Inside a shard the tree goes on to prune until blocks
are small, and what remains is compared on all 64 bits. Each shard reports a spanning forest of its links, never all
pairs, and connected components join the forests. A shard whose home x visitors work exceeds a bound is dealt out as a
grid: home rows and visitors are split by hash, and each piece of the ones meets each piece of the others in a task.

`keep_one` drops near copies by similarity (weighted, five-word shingles, 0.8 or more), where 64 bits and radius 4
would miss most: at similarity 0.8 each bit of a fingerprint differs with probability 0.15. It takes fingerprints of
256 bits and the same trees on their sixteen blocks, radius 1 each, of which a pair at 0.8 shares one with probability
0.995. Shards report minimum spanning forests by Hamming distance, whose edges are verified word by word. Where edges
fail, a forest says nothing about the pairs it left out, so the groups at failed edges are taken together as families,
and within a family every pair within the bits, the nearest first, is verified until its groups are joined. No pair is
missed: a pair of a shard is joined by a path of its forest, which goes from group to group by edges that failed.
Similar texts of different groups that share no block, or lie beyond the bits, are then found exactly: all texts deal
their shingles out to parts by a hash, and of two similar texts each has one of the other's parts among the first of its own
(`part_keys`); texts that meet there, and whose lengths allow the similarity, are verified word by word. A part is several
shingles, so texts meet on it that have a passage in common, and not by chance. Equal fingerprints prove nothing, since the
majority vote ignores lengths and minorities: only texts of the same words are one node from the start, and pairs whose
lengths alone rule the similarity out are left out.

Defined results: equal texts share a fingerprint and are expanded only at the end (`keep_one`: texts of equal words); a null or wordless text has
fingerprint zero and links like any other; a null doc_id keeps its row and counts for no component_id unless nothing
else is there (then null); repeated rows stay; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.bitmaps import Bitmap, bitmap_of
from lumenfold.llm.sampling import hashed_sample
from lumenfold.operators.components import components
from lumenfold.storage import materialise

SHINGLE = 4
RADIUS = 4
SEED = 42
QUARTERS, BITS = 4, 16
#: About so many home rows in a shard; the depth of the trees follows from it.
SHARD_ROWS = 16_000
MOST_DEPTH = 12
#: Comparisons that one task makes in one shard at most, before pruning.
SHARD_WORK = 1 << 32
BLOCK = 1 << 19
PIECE = 1 << 16
#: For `keep_one`: similarity, 64-bit words of a fingerprint, and bits within which pairs are verified (four deviations
#: above what the similarity gives).
SIMILAR = 0.8
WIDE = 4
WIDE_RADIUS = 62
#: Edges that a shard holds before it thins them to a forest.
HELD_EDGES = 1 << 18
#: A family is dealt out in parts of about so many texts, and every two parts meet in a task.
FAMILY_ROWS = 512
#: A class has a part for so many shingles of its smallest texts; the largest have two and a half times as many in a part.
PART_SHINGLES = 1.5
KEY_BYTES = 6
#: Rows whose parts tell which are frequent, and so many of these at most; both only order the parts of a text.
SAMPLE_ROWS = 2048
MOST_FREQUENT = 1 << 18
NTH = np.uint64(0xD6E8FEB86659FD93)


def shingle_hashes(text: bytes | None, width: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a text, in pieces."""
    words = (text or b"").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        yield np.array([digest(joined, SEED)], "<u8")
        return
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    n = len(words) - width + 1
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    for k in range(0, n, PIECE):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + PIECE], ends[k + width - 1 : k + width - 1 + PIECE], strict=False)], "<u8")


def fingerprint(text: bytes | None, width: int = SHINGLE, words: int = 1) -> np.ndarray:
    """`words` x 64 bits, each set by more than half of the shingles' hashes. Words after the first are of hashes mixed
    anew."""
    return voted(shingle_hashes(text, width), words)


def voted(pieces: Iterable[np.ndarray], words: int) -> np.ndarray:
    votes, n = np.zeros((words, 64), np.int64), 0
    for hashes in pieces:
        n += len(hashes)
        for w in range(words):
            if w:
                hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 | 1)
                hashes ^= hashes >> np.uint64(29)
            votes[w] += np.add.reduce(np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int64)
    if not n:
        return np.zeros(words, "<u8")
    return np.packbits(2 * votes > n, axis=1, bitorder="little").view("<u8").ravel()


def numbered(pieces: list[np.ndarray]) -> np.ndarray:
    """The shingle hashes of a text, sorted, the n-th of equal ones marked by n, so that bags are compared as sets."""
    distinct, times = np.unique(np.concatenate(pieces) if pieces else np.zeros(0, "<u8"), return_counts=True)
    if times.sum() == len(distinct):
        return distinct
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return np.sort(np.repeat(distinct, times) ^ (nth.astype("<u8") * NTH))


def classes(n: int, similar: float) -> list[int]:
    """Classes of sizes that a text of n shingles stands in. Class c has the sizes from 2**c up to those that can be similar to
    less than 2**(c + 1), so two similar texts share the class of the smaller one."""
    c = n.bit_length() - 1
    return [c, c - 1] if c and n * similar < (1 << c) + 1e-6 else [c]


def part_keys(own: np.ndarray, similar: float, frequent: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Keys of the parts of a text's `numbered` shingles: of two similar texts each has one of the other's.

    In a class all texts deal their shingles out to the same parts by a hash. Two texts that differ in d shingles have all but d
    parts in common, and a text whose filled parts are more than d shares a filled one. A similar text differs in at most
    d = (n + its size) * (1 - similar) / (1 + similar) shingles; so of the filled parts, which all texts put in one order, the
    first d + 1 do. Parts come in the order of their frequency, if known, and the larger ones, which chance fills least
    alike, first. A text with no more filled parts than d gives all of them and also its first shingles, on which it meets
    others of the kind. frequent: keys, sorted, and how often they were seen; without it, keys of all filled parts."""
    n, out = len(own), []
    for c in classes(n, similar) if n else []:
        low, salt = 1 << c, np.uint64((c + 1) * int(NTH) & 0xFFFFFFFFFFFFFFFF)
        parts = np.uint64(max(1, round(low / PART_SHINGLES)))
        mixed = (own ^ (own >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        at = mixed % parts
        order = np.argsort(at, kind="stable")
        first = np.nonzero(np.concatenate([[True], np.diff(at[order]) > 0]))[0]
        held = np.diff(np.concatenate([first, [n]]))
        keys = np.add.reduceat((mixed * np.uint64(0x94D049BB133111EB))[order], first) ^ salt
        keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(16)
        if frequent is None:
            out.append(keys)
            continue
        known, seen = frequent
        times = np.zeros(len(keys), np.int64)
        if len(known):
            near = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            times = np.where(known[near] == keys, seen[near], 0)
        most = n / similar if n < 2 * low else 2 * low
        d = math.floor((n + most) * (1 - similar) / (1 + similar) + 1e-6)
        out.append(keys[np.lexsort((keys, -held, times))[: d + 1]])
        if len(keys) <= d:
            few = own[: n - math.ceil(similar * n - 1e-9) + 1]
            out.append(((few ^ salt) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(16))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, "<u8")


def frequent_parts(docs: DataFrame, width: int, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Parts of at least three of SAMPLE_ROWS rows, as `part_keys` takes them. They rule the order of parts and so the work,
    not the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                keys = part_keys(numbered(list(shingle_hashes(value.as_py(), width))), similar)
                for k in range(0, len(keys), PIECE):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + PIECE].view("<i8"))], names=["key"])

    some = hashed_sample(docs.select("doc_id", F.col("text").cast("binary").alias("text")), SAMPLE_ROWS, "doc_id").select("text")
    counts = some.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("times")).where("times >= 3")
    found = counts.orderBy(F.desc("times"), "key").limit(MOST_FREQUENT).toArrow()
    keys = found.column("key").to_numpy().view("<u8")
    order = np.argsort(keys)
    return keys[order], found.column("times").to_numpy()[order]


def fingerprints(docs: DataFrame, width: int = SHINGLE, words: int = 1, similar: float | None = None) -> DataFrame:
    """(doc_id, fp, text_key, node, shingles) of every row: fp as bytes, text_key a hash of the text, node a hash of its
    words, which all texts with the same sequence of shingles share, and the number of shingles; with `similar` also the
    `parts`, six bytes each of `part_keys`."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_parts(docs, width, similar)) if similar else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, keys, nodes, sizes, firsts = [], [], [], [], []
            for value in batch.column(1):  # one text at a time is a Python object
                text = value.as_py()
                pieces = shingle_hashes(text, width)
                if frequent:
                    pieces = list(pieces)
                    firsts.append(part_keys(numbered(pieces), similar, frequent.value).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes())
                fp.append(voted(pieces, words).astype(">u8").tobytes())
                keys.append(xxhash.xxh64_intdigest(b"\0" if text is None else text + b"\1", SEED))
                spoken = (text or b"").lower().split()
                nodes.append(xxhash.xxh64_intdigest(b" ".join(spoken), SEED))
                sizes.append(max(len(spoken) - width + 1, 1 if spoken else 0))
            key, node = (pa.array(np.array(x, "<u8").view("<i8")) for x in (keys, nodes))
            columns = [batch.column(0), pa.array(fp, pa.binary()), key, node, pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(firsts, pa.binary())] if frequent else []), names=["doc_id", "fp", "text_key", "node", "shingles", "parts"][: 6 if frequent else 5])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = f"doc_id {kind}, fp binary, text_key long, node long, shingles int" + (", parts binary" if frequent else "")
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, made)


class Forest:
    """One tree of vantage points over the 16-bit space, cut at `depth`: leaves, and who visits them."""

    def __init__(self, depth: int, radius: int = RADIUS // QUARTERS) -> None:
        self.radius = radius
        space = np.arange(1 << BITS, dtype=np.uint16)
        self.home = np.zeros(1 << BITS, np.int32)
        visits: list[tuple[np.ndarray, int]] = []
        stack, leaf = [(space, space, 0, 1)], 0
        while stack:
            own, coming, level, node = stack.pop()
            if level == depth or len(own) < 2:
                self.home[own] = leaf
                visits.append((coming, leaf))
                leaf += 1
                continue
            near, far, near_coming, far_coming = split(own, coming, node, radius)
            stack += [(far, far_coming, level + 1, 2 * node + 1), (near, near_coming, level + 1, 2 * node)]
        self.leaves = leaf
        pairs = np.concatenate([np.stack([v.astype(np.int64), np.full(len(v), k)], 1) for v, k in visits])
        pairs = pairs[pairs[:, 1] > self.home[pairs[:, 0]]]
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        self.later = pairs[:, 1].astype(np.int32)
        self.first = np.searchsorted(pairs[:, 0], np.arange((1 << BITS) + 1)).astype(np.int64)


def vantage(node: int) -> int:
    return xxhash.xxh32_intdigest(node.to_bytes(8, "little"), SEED) & 0xFFFF


def split(own: np.ndarray, coming: np.ndarray, node: int, radius: int) -> tuple[np.ndarray, ...]:
    """Inside and outside of the median distance from the node's vantage point, and the balls that overlap each."""
    point = np.uint16(vantage(node))
    d, e = np.bitwise_count(own ^ point), np.bitwise_count(coming ^ point)
    median = int(np.sort(d)[(len(d) - 1) // 2])
    if median == int(d.max()):
        median -= 1
    return own[d <= median], own[d > median], coming[e.astype(int) - radius <= median], coming[e.astype(int) + radius > median]


def forest(a: np.ndarray, b: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Which of the edges (a, b) of length d form a minimum spanning forest over n nodes."""
    parent, chosen = np.arange(n), []
    for level in np.unique(d):
        left = np.nonzero(d == level)[0]
        while True:
            ra, rb = parent[a[left]], parent[b[left]]
            apart = ra != rb
            if not apart.any():
                break
            left, high, low = left[apart], np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart]
            roots, first = np.unique(high, return_index=True)  # each root is hung up once, on a smaller one
            chosen.append(left[first])
            parent[roots] = low[first]
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
    return np.concatenate(chosen) if chosen else np.zeros(0, int)


def shard_links(fps: np.ndarray, owned: np.ndarray, coming: np.ndarray, block: int, limit: int, radius: int, sizes: np.ndarray | None = None, similar: float = SIMILAR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimum spanning forest of the links between owned and coming rows of `fps` (rows x words): ends and distance.
    If `sizes` are given, only of those whose sizes allow the similarity.

    Further vantage points on the block's bits prune until the rest is small enough to compare."""
    word, shift = divmod(block * BITS, 64)
    part = ((fps[:, word] >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
    stack: list[tuple] = [(owned, coming, 1 << 20, 0)]
    held: list[tuple[np.ndarray, ...]] = []

    def thin() -> None:
        a, b, d = (np.concatenate(x) for x in zip(*held, strict=True))
        keep = forest(a, b, d, len(fps))
        held[:] = [(a[keep], b[keep], d[keep])]

    count = 0
    while stack:
        own, visit, node, level = stack.pop()
        if not len(own) or not len(visit):
            continue
        if len(own) * len(visit) > BLOCK and level < 24:
            point = np.uint16(vantage(node))
            d, e = np.bitwise_count(part[own] ^ point).astype(int), np.bitwise_count(part[visit] ^ point).astype(int)
            median = int(np.sort(d)[(len(d) - 1) // 2])
            median -= median == d.max()
            if d.min() <= median:
                stack += [(own[d <= median], visit[e - radius <= median], 2 * node, level + 1), (own[d > median], visit[e + radius > median], 2 * node + 1, level + 1)]
            else:  # all at one distance: another vantage point
                stack.append((own, visit[abs(e - d[0]) <= radius], 2 * node + 1, level + 1))
            continue
        step = max(1, BLOCK // len(own))
        for k in range(0, len(visit), step):
            some = visit[k : k + step]
            away = np.bitwise_count(fps[some, 0][:, None] ^ fps[own, 0][None, :])
            if fps.shape[1] > 1:
                away = away.astype(np.uint16)
                for w in range(1, fps.shape[1]):
                    away += np.bitwise_count(fps[some, w][:, None] ^ fps[own, w][None, :])
            i, j = np.nonzero(away <= limit)
            if sizes is not None:
                some_sizes, own_sizes = sizes[some][i], sizes[own][j]
                fit = np.minimum(some_sizes, own_sizes) >= similar * np.maximum(some_sizes, own_sizes)
                i, j = i[fit], j[fit]
            if len(i):
                held.append((some[i].astype(np.int32), own[j].astype(np.int32), away[i, j].astype(np.uint8)))
                count += len(i)
                if count > HELD_EDGES:
                    thin()
                    count = len(held[0][0])
    if not held:
        none = np.zeros(0, int)
        return none, none, none
    thin()
    return held[0]


def links(fps: DataFrame, limit: int = RADIUS, words: int = 1, similar: float = SIMILAR) -> DataFrame:
    """(src, dst, bits): spanning forests, shard by shard, of all links within `limit` bits that meet in a block, between
    the distinct fingerprints `fp`; or, if there are columns `node` and `shingles`, between nodes whose numbers of shingles
    allow the similarity. With limit < 2 * (4 * words) all links meet."""
    spark = fps.sparkSession
    n = fps.count()
    blocks, radius = QUARTERS * words, RADIUS // QUARTERS
    depth = min(MOST_DEPTH, max(1, math.ceil(math.log2(max(2, n / SHARD_ROWS)))))
    tree = Forest(depth, radius)
    held = spark.sparkContext.broadcast((tree.home, tree.first, tree.later))  # 65,536 points and their visits
    width = (1 << BITS) + 1
    name = "node" if "node" in fps.columns else "fp"
    carried = fps.select("fp", *(["node", "shingles"] if name == "node" else []))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in carried.schema)
    kind = carried.schema[name].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, first, later = held.value
        for batch in batches:
            data = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">u8").astype("<u8").reshape(-1, words)
            for q in range(blocks):
                word, shift = divmod(q * BITS, 64)
                part = ((data[:, word] >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.int64)
                times = first[part + 1] - first[part]
                at = np.repeat(first[part] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
                shard = q * width + np.concatenate([home[part], later[at]])
                own = np.concatenate([np.ones(len(data), bool), np.zeros(len(at), bool)])
                row = np.concatenate([np.arange(len(data)), np.repeat(np.arange(len(data)), times)])
                for k in range(0, len(row), PIECE):
                    yield pa.RecordBatch.from_arrays([pa.array(shard[k : k + PIECE].astype(np.int32)), pa.array(own[k : k + PIECE]), *[c.take(pa.array(row[k : k + PIECE])) for c in batch.columns]], names=["shard", "own", *batch.schema.names])

    placed = carried.mapInArrow(place, f"shard int, own boolean, {kinds}")
    counted = placed.groupBy("shard").agg(F.count_if("own").alias("own"), F.count("*").alias("all"))
    cells = F.ceil(F.col("own") * F.col("all") / F.lit(float(SHARD_WORK)))
    rows = F.ceil(F.sqrt(cells * F.col("own") / F.col("all")))
    # a row for each shard that is dealt out, of which there are at most blocks x leaves
    heavy = materialise(counted.where(F.col("own") * F.col("all") > SHARD_WORK).select("shard", rows.cast("int").alias("rows"), F.ceil(cells / rows).cast("int").alias("columns")))
    split_up = placed.join(F.broadcast(heavy), "shard", "left")
    mine = lambda parts, seed: F.pmod(F.xxhash64(name, F.lit(seed)), F.coalesce(parts, F.lit(1))).cast("int")
    places = split_up.withColumn("row", mine(F.col("rows"), 1)).withColumn("column", mine(F.col("columns"), 2))
    every = lambda parts: F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1)
    cell = lambda row, column: F.struct(row.alias("row"), column.alias("column"))
    as_home = F.when(F.col("own"), F.transform(every(F.col("columns")), lambda c: cell(F.col("row"), c)))
    as_visitor = F.transform(every(F.col("rows")), lambda r: cell(r, F.col("column")))
    dealt = places.withColumn("cell", F.explode(F.array_union(F.coalesce(as_home, F.array().cast("array<struct<row:int,column:int>>")), as_visitor)))
    dealt = dealt.select("shard", F.col("cell.row").alias("at_row"), F.col("cell.column").alias("at_column"), (F.col("own") & (F.col("cell.row") == F.col("row"))).alias("own"), (F.col("cell.column") == F.col("column")).alias("visits"), *carried.columns)

    def search(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches))
        names = got.column(name).combine_chunks()
        data = np.frombuffer(b"".join(got.column("fp").to_pylist()), ">u8").astype("<u8").reshape(-1, words)
        sizes = got.column("shingles").to_numpy() if name == "node" else None
        own, visits = (np.nonzero(got.column(c).to_numpy())[0] for c in ("own", "visits"))
        a, b, d = shard_links(data, own, visits, key[0].as_py() // width, limit, radius, sizes, similar)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b)), pa.array(d.astype(np.int32))], names=["src", "dst", "bits"])

    found = dealt.groupBy("shard", "at_row", "at_column").applyInArrow(search, f"src {kind}, dst {kind}, bits int")
    return found.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "bits").where("src <> dst").distinct()


def near_duplicates(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) of every row, fp as bytes, the highest bits first."""
    prints = materialise(fingerprints(docs, width).select("doc_id", "fp"))
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    root = components(links(distinct))
    rooted = distinct.join(root, distinct.fp == root.node, "left").select("fp", "least_id", F.coalesce("component", "fp").alias("root"))
    rooted = materialise(rooted)
    least = materialise(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")))
    named = materialise(rooted.join(least, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def _similar(pairs: DataFrame, width: int, similar: float) -> DataFrame:
    """The rows of (src, dst, one, two), texts as bytes, whose weighted shingles are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2), batch.column(3), strict=True):
                one, two = one.as_py(), two.as_py()
                if last[0] != one:
                    last = (one, Counter(h for piece in shingle_hashes(one, width) for h in piece.tolist()))
                a, b = last[1], Counter(h for piece in shingle_hashes(two, width) for h in piece.tolist())
                common = sum(min(k, b[h]) for h, k in a.items() if h in b)
                total = sum(a.values()) + sum(b.values()) - common
                keep.append(not total or common >= similar * total)
            yield batch.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["src"].dataType.simpleString()
    return pairs.mapInArrow(run, f"src {kind}, dst {kind}")


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of `nodes` (node, first). Texts of other rows stop at the bitmap and are not shuffled."""
    named = materialise(nodes.select("node", "first.doc_id", "first.text_key"))
    text = F.col("text").cast("binary")
    candidates = admitted(docs.select("doc_id", "text"), bitmap_of(named, "text_key"), True).select("doc_id", text.alias("text"), text_key().alias("text_key"))
    match = candidates.doc_id.eqNullSafe(named.doc_id) & (candidates.text_key == named.text_key)
    return materialise(named.join(candidates, match).select("node", "text").dropDuplicates(["node"]))


def _bag(text: bytes | None, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of a text, sorted, and how often each occurs."""
    pieces = list(shingle_hashes(text, width))
    return np.unique(np.concatenate(pieces) if pieces else np.zeros(0, "<u8"), return_counts=True)


def family_links(fps: np.ndarray, roots: np.ndarray, owned: np.ndarray, coming: np.ndarray, sizes: np.ndarray, texts: pa.ChunkedArray, width: int, similar: float) -> list[tuple[int, int]]:
    """Similar pairs between owned and coming rows that join the groups `roots` as far as all of their similar pairs do."""
    parent = list(range(int(roots.max()) + 1))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    bags: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    joined = []
    away = np.zeros((len(coming), len(owned)), np.uint16)
    for w in range(fps.shape[1]):
        away += np.bitwise_count(fps[coming, w][:, None] ^ fps[owned, w][None, :])
    near = (away <= WIDE_RADIUS) & (roots[coming][:, None] != roots[owned][None, :])
    one, two = sizes[coming][:, None], sizes[owned][None, :]
    i, j = np.nonzero(near & (np.minimum(one, two) >= similar * np.maximum(one, two)))
    nearest = np.argsort(away[i, j], kind="stable")
    for a, b in zip(coming[i[nearest]].tolist(), owned[j[nearest]].tolist(), strict=True):
        one, two = top(int(roots[a])), top(int(roots[b]))
        if one == two:
            continue
        for x in (a, b):
            if x not in bags:
                bags[x] = _bag(texts[x].as_py(), width)
        (u, k), (v, m) = bags[a], bags[b]
        if not len(u) or not len(v):
            common = 0
        else:
            at = np.minimum(np.searchsorted(v, u), len(v) - 1)
            common = int(np.minimum(k, m[at])[v[at] == u].sum())
        total = int(k.sum() + m.sum()) - common
        if not total or common >= similar * total:
            parent[max(one, two)] = min(one, two)
            joined.append((a, b))
    return joined


def family_pairs(members: DataFrame, texts: DataFrame, width: int, similar: float) -> DataFrame:
    """(src, dst): similar pairs that join the groups of each family of `members` (node, fp, shingles, root, family)."""
    sizes = materialise(members.groupBy("family").agg(F.ceil(F.count("*") / FAMILY_ROWS).cast("int").alias("parts")))
    rows = members.join(sizes, "family").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).join(texts, "node")
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("family", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "node", "fp", "shingles", "root", "text")
    kind = members.schema["node"].dataType.simpleString()

    def search(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches))
        nodes = got.column("node").combine_chunks()
        data = np.frombuffer(b"".join(got.column("fp").to_pylist()), ">u8").astype("<u8").reshape(got.num_rows, -1)
        roots = got.column("root").combine_chunks().dictionary_encode().indices.to_numpy()
        mine = got.column("mine").to_numpy()
        ends = family_links(data, roots, np.nonzero(mine == key[1].as_py())[0], np.nonzero(mine == key[2].as_py())[0], got.column("shingles").to_numpy(), got.column("text"), width, similar)
        yield pa.RecordBatch.from_arrays([nodes.take(pa.array([e[k] for e in ends], pa.int64())) for k in (0, 1)], names=["src", "dst"])

    return dealt.groupBy("family", "low", "high").applyInArrow(search, f"src {kind}, dst {kind}")


def similar_groups(docs: DataFrame, nodes: DataFrame, edges: DataFrame, width: int, similar: float) -> DataFrame:
    """(node, component) of the similar pairs among `nodes` (node, fp, shingles, first), of which `edges` are forests."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    texts = _texts(docs, ends.join(nodes, "node"))
    pairs = edges.join(texts.select(F.col("node").alias("dst"), F.col("text").alias("two")), "dst").join(texts.select(F.col("node").alias("src"), F.col("text").alias("one")), "src")
    good = materialise(_similar(pairs.select("src", "dst", "one", "two"), width, similar))
    root = components(good)
    rooted = materialise(nodes.join(root, "node", "left").select("node", "fp", "shingles", F.coalesce("component", "node").alias("root")))
    apart = edges.join(good, ["src", "dst"], "left_anti")
    for c in ("src", "dst"):
        apart = apart.join(rooted.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c)
    apart = materialise(apart.select("src_root", "dst_root").where("src_root <> dst_root").distinct())
    if apart.isEmpty():
        return root
    family = components(apart, "src_root", "dst_root").select(F.col("node").alias("root"), F.col("component").alias("family"))
    members = materialise(rooted.join(family, "root"))
    # a node without an edge has no pair within the bits
    more = materialise(family_pairs(members, texts, width, similar))
    return components(good.union(more))


def part_pairs(prints: DataFrame, rooted: DataFrame, similar: float) -> DataFrame:
    """(src, dst): pairs of nodes of different groups that share a key of `part_keys` and may be similar.

    prints: (node, shingles, parts), rooted: (node, root). Keys of a single row stop at a bitmap. Groups meet before their
    nodes do, so that a large group makes no pairs of its own."""

    def keys_of(rows: list[bytes]) -> np.ndarray:
        keys = np.zeros((sum(map(len, rows)) // KEY_BYTES, 8), np.uint8)
        keys[:, :KEY_BYTES] = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, KEY_BYTES)
        return keys.view("<i8").ravel()

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = keys_of(batch.column(0).to_pylist())
            for k in range(0, len(keys), PIECE):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + PIECE])], names=["key"])

    met = materialise(prints.select("parts").mapInArrow(every, "key long").groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key"))
    held = prints.sparkSession.sparkContext.broadcast(bitmap_of(met, "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2).to_pylist()
            keys, row = keys_of(rows), np.repeat(np.arange(len(rows)), [len(r) // KEY_BYTES for r in rows])
            stays = np.nonzero(held.value.admits(keys))[0]
            for k in range(0, len(stays), PIECE):
                at = stays[k : k + PIECE]
                of = pa.array(row[at])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(keys[at])], names=["node", "n", "key"])

    placed = prints.select("node", "shingles", "parts").mapInArrow(run, "node long, n int, key long").distinct()
    placed = materialise(placed.join(rooted.select("node", "root"), "node"))
    apart = placed.groupBy("key").agg(F.min("root").alias("one"), F.max("root").alias("other")).where("one <> other").select("key")
    placed = materialise(placed.join(apart, "key", "left_semi"))
    roots = placed.select("key", "root").distinct()
    groups = roots.withColumnRenamed("root", "src_root").join(roots.withColumnRenamed("root", "dst_root"), "key").where("src_root < dst_root")
    one = placed.select("key", F.col("root").alias("src_root"), F.col("node").alias("src"), F.col("n").alias("n_src"))
    two = placed.select("key", F.col("root").alias("dst_root"), F.col("node").alias("dst"), F.col("n").alias("n_dst"))
    pairs = groups.join(one, ["key", "src_root"]).join(two, ["key", "dst_root"]).where(F.least("n_src", "n_dst") >= similar * F.greatest("n_src", "n_dst"))
    return pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def all_groups(docs: DataFrame, prints: DataFrame, rooted: DataFrame, width: int, similar: float) -> DataFrame:
    """`rooted` (node, first, root) with the groups joined that any similar pair connects."""
    pairs = materialise(part_pairs(prints, rooted, similar))
    ends = pairs.select(F.col("src").alias("node")).union(pairs.select(F.col("dst").alias("node"))).distinct()
    texts = _texts(docs, ends.join(rooted, "node"))
    both = pairs.join(texts.select(F.col("node").alias("dst"), F.col("text").alias("two")), "dst").join(texts.select(F.col("node").alias("src"), F.col("text").alias("one")), "src")
    good = materialise(_similar(both.select("src", "dst", "one", "two"), width, similar))
    if good.isEmpty():
        return rooted
    for c in ("src", "dst"):
        good = good.join(rooted.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c)
    joined = components(good, "src_root", "dst_root").select(F.col("node").alias("root"), "component")
    return materialise(rooted.join(joined, "root", "left").select("node", "first", F.coalesce("component", "root").alias("root")))


def keep_one(docs: DataFrame, width: int = 5, similar: float = SIMILAR) -> DataFrame:
    """`docs` without near copies: of each group the row of the smallest doc_id stays (a null doc_id comes last; among
    equal ids the text decides, and of equal rows one stays)."""
    prints = materialise(fingerprints(docs, width, WIDE, similar))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    distinct = materialise(prints.groupBy("node").agg(F.min(order).alias("first"), F.min("fp").alias("fp"), F.min("shingles").alias("shingles")))
    edges = materialise(links(distinct, WIDE_RADIUS, WIDE, similar).select("src", "dst"))
    root = similar_groups(docs, distinct, edges, width, similar)
    rooted = materialise(distinct.join(root, "node", "left").select("node", "first", F.coalesce("component", "node").alias("root")))
    rooted = all_groups(docs, prints, rooted, width, similar)
    winners = materialise(rooted.groupBy("root").agg(F.min("first").alias("winner")))
    stays = materialise(rooted.join(winners, "root").select("node", "winner"))
    keyed = prints.select("node", "doc_id", "text_key").join(stays, "node")
    lost = keyed.where(~(F.col("doc_id").eqNullSafe(F.col("winner.doc_id")) & (F.col("text_key") == F.col("winner.text_key"))))
    again = prints.groupBy("doc_id", "text_key").count().where("count > 1")  # rows that repeat id and text
    lost = materialise(lost.select("doc_id", "text_key", F.lit(True).alias("lost")).distinct().unionByName(again.select("doc_id", "text_key", F.lit(False).alias("lost"))))
    bitmap = bitmap_of(lost, "text_key")
    own_id = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    keys = lost.select(own_id("doc_id").alias("id"), F.col("text_key").alias("key"), "lost")
    gone, repeated = keys.where("lost").drop("lost"), keys.where("NOT lost").drop("lost")
    doubtful = admitted(docs, bitmap, True).select(own_id("doc_id").alias("id"), text_key().alias("key"), F.struct(*docs.columns).alias("row"))
    doubtful = doubtful.join(gone, ["id", "key"], "left_anti")
    single = doubtful.join(repeated, ["id", "key"], "left_anti")
    once = doubtful.join(repeated, ["id", "key"], "left_semi").dropDuplicates(["id", "key"])
    return admitted(docs, bitmap, False).unionByName(single.select("row.*")).unionByName(once.select("row.*"))


def admitted(docs: DataFrame, bitmap: Bitmap, wanted: bool) -> DataFrame:
    """The rows of `docs` whose text's key the bitmap admits, or the others."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.array([xxhash.xxh64_intdigest(b"\0" if t is None else t.encode() + b"\1", SEED) for t in (x.as_py() for x in batch.column(place))], "<u8")
            yield batch.filter(pa.array(held.value.admits(keys) == wanted, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def text_key() -> Column:
    """The hash of a text that `fingerprints` makes, in SQL."""
    raw = F.col("text").cast("binary")
    return F.xxhash64(F.when(F.col("text").isNull(), F.lit(b"\0")).otherwise(F.concat(raw, F.lit(b"\1"))))


def op5_neardup(spark, sf_dir):
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
