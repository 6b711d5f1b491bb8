"""Exact top-k by integer inner product: M-trees, searched best-first.

Components become floor(1024 x). With M the largest norm of all rows, a row x gets one further coordinate
sqrt(M**2 - |x|**2) and a query gets 0 there; then |q - x|**2 = |q|**2 + M**2 - 2 q.x, a metric in which nearer means
a larger inner product. M-trees stand on that metric.

Index. Routing vectors are chosen from a bounded sample (SAMPLE rows) by farthest-first; every row goes to its nearest
one, and each routing vector's rows are dealt by a hash of their id into trees of about TREE_ROWS rows, so a crowd of
equal vectors becomes many trees. A tree is paged: a page holds up to PAGE entries with their distances to the page's
own routing vector, and each child page has a covering radius. Trees are written as Parquet rows.

Search. Queries are taken QUERY_BLOCK at a time and sent to all trees. A tree visits pages in the order of their lower
bounds d(q, routing) - radius and stops when that exceeds the distance of the k-th candidate. Entries whose stored
parent distance proves them too far by the triangle inequality are skipped without computing a distance. Every query
starts from the k-th score it reaches within the sample, so that far trees are closed at once. Scores are integers,
bounds get a margin for rounding, and ties are kept until the last merge, which takes the smaller vec_id.

Defined results: null vectors, null or non-finite components and null vec_ids take no part; vectors of unequal length
are padded with zeros; rows that repeat a vec_id are candidates one by one for other queries, while as a query an id
is answered once, for its first vector in order, and never gets rows of its own id; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.sampling import hashed_sample
from lumenfold.storage import materialise

TOP = 10
EVERY = 100
SCALE = 1024
SAMPLE = 1024
TREE_ROWS = 2048
PAGE = 64
MOST_ROUTES = 256
QUERY_BLOCK = 4096


def integer_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, x): x is array<long>; only rows that take part."""
    whole = "vec_id IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    return table.where(whole).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("x"))


def padded(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def lifted(x: np.ndarray, limit: float) -> np.ndarray:
    """Rows with the coordinate that makes their norms equal."""
    own = (x.astype(float) ** 2).sum(1)
    return np.concatenate([x.astype(float), np.sqrt(np.maximum(limit - own, 0))[:, None]], 1)


def spread(points: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first choice of at most `count` distinct points."""
    chosen = [0]
    far = np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < count and far.max() > 1e-9:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return np.array(chosen)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


class Tree:
    """Pages in a list. A leaf has rows and their parent distances; an inner page has children with routing vectors,
    parent distances and covering radii. Page 0 is the root."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, limit: float) -> None:
        self.ids, self.x, self.limit = ids, x, limit
        self.points = lifted(x, limit)
        self.pages: list[tuple] = [()]
        root = int(spread(self.points, 2)[-1])
        self.root_radius = float(np.linalg.norm(self.points - self.points[root], axis=1).max())
        self._fill(0, np.arange(len(ids)), root)
        self.root = self.points[root]
        del self.points

    def _fill(self, page: int, rows: np.ndarray, route: int) -> None:
        to_route = np.linalg.norm(self.points[rows] - self.points[route], axis=1)
        if len(rows) <= PAGE:
            self.pages[page] = (True, rows, to_route)
            return
        picks = rows[spread(self.points[rows], max(2, min(PAGE, -(-len(rows) // (PAGE // 2)))))]
        d = distances(self.points[rows], self.points[picks])
        owner = d.argmin(1)
        groups = [(int(p), rows[owner == k]) for k, p in enumerate(picks)]
        groups = [g for g in groups if len(g[1])]
        if max(len(g) for _, g in groups) > 0.9 * len(rows):  # nearly equal points: even pieces
            groups = [(int(g[0]), g) for g in np.array_split(rows, -(-len(rows) // PAGE))]
            if len(groups) > PAGE:
                groups = [(int(g[0]), g) for g in np.array_split(rows, PAGE)]
        children, radii = [], []
        for pick, group in groups:
            children.append(len(self.pages))
            self.pages.append(())
            radii.append(float(np.linalg.norm(self.points[group] - self.points[pick], axis=1).max()))
            self._fill(children[-1], group, pick)
        routes = np.array([p for p, _ in groups])
        parents = np.linalg.norm(self.points[routes] - self.points[route], axis=1)
        self.pages[page] = (False, np.array(children), self.points[routes], parents, np.array(radii))

    def nearest(self, query: np.ndarray, own: int, k: int, least: int | None) -> list[tuple[int, int]]:
        """(score, -vec_id) of the k best rows, best first; `least` is a score known to be reached k times elsewhere."""
        q = np.append(query.astype(float), 0.0)
        norm = float((query.astype(float) ** 2).sum())
        slack = 1e-6 * (1 + self.limit**0.5)
        reach = lambda score: max(norm + self.limit - 2 * score, 0.0) ** 0.5 + slack
        radius = np.inf if least is None else reach(least)
        best: list[tuple[int, int]] = []
        to_root = float(np.linalg.norm(q - self.root))
        queue = [(max(0.0, to_root - self.root_radius), 0, to_root)]
        while queue:
            bound, page, to_route = heapq.heappop(queue)
            if bound > radius:
                break
            leaf, *held = self.pages[page]
            if leaf:
                rows, parents = held
                rows = rows[np.abs(to_route - parents) <= radius]
                rows = rows[self.ids[rows] != own]
                if not len(rows):
                    continue
                scores = self.x[rows] @ query
                for s, i in zip(scores.tolist(), self.ids[rows].tolist(), strict=True):
                    if least is not None and s < least:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (s, -i))
                    elif (s, -i) > best[0]:
                        heapq.heapreplace(best, (s, -i))
                if len(best) == k:
                    radius = min(radius, reach(best[0][0]))
            else:
                children, routes, parents, radii = held
                open_ = np.nonzero(np.abs(to_route - parents) - radii <= radius)[0]
                if len(open_):
                    d = np.linalg.norm(routes[open_] - q, axis=1)
                    for c, dist, r in zip(children[open_].tolist(), d.tolist(), radii[open_].tolist(), strict=True):
                        if dist - r <= radius:
                            heapq.heappush(queue, (max(0.0, dist - r), c, dist))
        return sorted(best, reverse=True)


def build(vectors: DataFrame) -> tuple[DataFrame, dict]:
    """The trees, one binary row each, and what searching needs to know. Written once."""
    spark = vectors.sparkSession
    norm = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    facts = vectors.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width"), F.max(norm).alias("limit")).first()
    n, width, limit = facts["n"], facts["width"] or 1, float(facts["limit"] or 0.0)
    sampled = hashed_sample(vectors.select("vec_id", "x"), SAMPLE, "vec_id", "x", total=n).collect()
    facts = {"width": width, "limit": limit, "ids": np.array([r["vec_id"] for r in sampled], np.int64), "x": padded([r["x"] for r in sampled], width)}
    points = lifted(facts["x"], limit)
    routes = points[spread(points, min(MOST_ROUTES, max(1, n // (8 * TREE_ROWS))))] if len(points) else points
    held = spark.sparkContext.broadcast(routes)  # at most MOST_ROUTES vectors

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = padded(batch.column(1).to_pylist(), width)
            near = distances(lifted(x, limit), held.value).argmin(1) if len(x) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32))], names=["vec_id", "x", "route"])

    routed = materialise(vectors.select("vec_id", "x").mapInArrow(route, "vec_id long, x array<long>, route int"))
    trees = {r["route"]: max(1, -(-r["count"] // TREE_ROWS)) for r in routed.groupBy("route").count().collect()}
    parts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in trees.items() for v in kv]), F.col("route")), F.lit(1)) if trees else F.lit(1)
    dealt = routed.withColumn("tree", F.pmod(F.xxhash64("vec_id", F.lit(1)), parts).cast("int"))

    def plant(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches))
        ids = got.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        tree = Tree(ids[order], padded(got.column("x").to_pylist(), width)[order], limit)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(tree, 5)], pa.binary())], names=["tree"])

    return materialise(dealt.groupBy("route", "tree").applyInArrow(plant, "tree binary")), facts


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score) for every query id of `queries` (vec_id, x) against all of `vectors`."""
    spark = vectors.sparkSession
    trees, facts = build(vectors)
    width = facts["width"]
    asked = materialise(queries.groupBy("vec_id").agg(F.min("x").alias("x")))
    blocks = max(1, -(-asked.count() * 5 // (4 * QUERY_BLOCK)))
    found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)) == b).orderBy("vec_id").collect()
        ids = np.array([r["vec_id"] for r in rows], np.int64)
        x = padded([r["x"][:width] for r in rows], width)
        least = []
        for i, q in zip(ids, x, strict=True):
            scores = np.sort(facts["x"][facts["ids"] != i] @ q)
            least.append(int(scores[-k]) if len(scores) >= k else None)
        held = spark.sparkContext.broadcast((ids, x, least))  # at most about QUERY_BLOCK vectors

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, x, least = held.value
            for batch in batches:
                for blob in batch.column(0):
                    tree = pickle.loads(blob.as_buffer())
                    hits = [(int(i), -v, s) for i, q, low in zip(ids, x, least, strict=True) for s, v in tree.nearest(q, i, k, low)]
                    cols = list(zip(*hits, strict=True)) or [[], [], []]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

        found = found.unionByName(trees.mapInArrow(search, found.schema))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_topk(spark, sf_dir):
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score
      FROM v q, v WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
