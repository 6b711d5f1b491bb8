"""Centroid clustering of integer vectors, exact: float32 screening, integers where it cannot decide.

Vectors with exactly DIMENSIONS components, none null or non-finite, are kept; component x becomes floor(SCALE * x). For
the nearest of k centroids it is enough to compare |c|**2 - 2 x.c. A batch of vectors is multiplied with all centroids in
float32; with u = 2**-24 and d products, whatever the order of summation, the product of the rounded numbers is off by at
most g |x| |c|, g = (d + 2) u / (1 - (d + 2) u) (two more roundings for x and c themselves, and Cauchy-Schwarz). That gives
every centroid an interval. Centroids whose interval lies above the lowest upper end cannot win; where more than one is
left, their distances are computed in integers, and the smaller number wins a tie. A product that overflows float32 has no
interval and is computed in integers at once. Distances of results are integers always.

A round is one pass: every task sums its vectors per centroid exactly and hands over k * DIMENSIONS sums, which a grouped
sum adds up; means are floors of exact quotients. What reaches the driver is k centroids. Centroids travel to the
tasks in the closure: k * DIMENSIONS numbers, which do not grow with the data.

Defined results: an empty or wholly unusable table gives no rows; with fewer than k kept vectors, every one starts a
centroid; rows that repeat a vec_id are vectors of their own; a null vec_id counts as the empty text in the hash; equal
hashes are ordered by components; numbers beyond 64 bits saturate (components, distances and their sums); extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.storage import materialise

DIMENSIONS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
#: Rows of one matrix product.
BATCH = 8192
#: Squared differences of components up to this, summed over 2**9 of them, stay within 64 bits.
SMALL = 1 << 26
LARGEST = (1 << 63) - 1
UNIT = 2.0**-24


def kept_vectors(table: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x array<long>) of the vectors that take part."""
    whole = f"embedding IS NOT NULL AND size(embedding) = {int(dimensions)} AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    return table.where(whole).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("x"))


def first_centroids(kept: DataFrame, k: int, seed: int = 1) -> list[list[int]]:
    """The k vectors of the smallest hash of their id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [r["x"] for r in kept.select(key.alias("key"), "x").orderBy("key", "x").limit(k).collect()]


def exact_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of paired rows: int64 where they fit, else Python integers."""
    if max(_height(x), _height(c)) < SMALL and x.shape[1] <= 512:
        return ((x - c) ** 2).sum(1)
    return ((x.astype(object) - c.astype(object)) ** 2).sum(1)


def _height(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of every row of x, exact, ties to the smaller number."""
    n, d = x.shape
    own = [sum(int(v) * int(v) for v in c) for c in centroids]
    square = np.array([float(s) for s in own])
    with np.errstate(over="ignore", invalid="ignore"):
        product = (x.astype(np.float32) @ centroids.T.astype(np.float32)).astype(np.float64)
        norms = np.sqrt((x.astype(np.float64) ** 2).sum(1))[:, None] * np.sqrt(square)[None, :]
        g = (d + 2) * UNIT / (1 - (d + 2) * UNIT)
        score = square[None, :] - 2 * product
        # the last term: roundings of norms, squares and the subtraction in doubles
        wide = 2 * g * norms * (1 + 2.0**-40) + 2.0**-40 * (square[None, :] + 2 * np.abs(product)) + 1e-9
        low, high = score - wide, score + wide
        known = np.isfinite(low) & np.isfinite(high)
        open_ = ~known | (low <= np.where(known, high, np.inf).min(1)[:, None])
    out = open_.argmax(1)
    rows = np.flatnonzero(open_.sum(1) > 1)
    if len(rows):
        at, which = np.nonzero(open_[rows])  # centroids of a row in ascending order
        exact = exact_distances(x[rows[at]], centroids[which])
        best: dict[int, tuple[int, int]] = {}
        if exact.dtype == object:
            for r, c, v in zip(at.tolist(), which.tolist(), exact.tolist(), strict=True):
                if r not in best or v < best[r][0]:
                    best[r] = (v, c)
            out[rows] = [best[r][1] for r in range(len(rows))]
        else:
            order = np.lexsort((which, exact, at))
            first = np.r_[True, at[order][1:] != at[order][:-1]]
            out[rows] = which[order][first]
    return out


def _blocks(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            yield part.column("vec_id"), part.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def _sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    k, d = centroids.shape
    totals, counts = np.zeros((k, d), object), np.zeros(k, np.int64)
    for _, x in _blocks(batches, d):
        home = nearest(x, centroids)
        counts += np.bincount(home, minlength=k)
        fits = _height(x) < 1 << 40
        for c in np.unique(home):
            own = x[home == c]
            totals[c] += (own.sum(0) if fits else own.astype(object).sum(0)).astype(object)
    full = np.flatnonzero(counts)
    yield pa.RecordBatch.from_pydict(
        {
            "cluster": pa.array(np.repeat(full, d), pa.int32()),
            "part": pa.array(np.tile(np.arange(d), len(full)), pa.int32()),
            "n": pa.array(np.repeat(counts[full], d), pa.int64()),
            "total": pa.array([Decimal(int(v)) for v in totals[full].ravel()], pa.decimal128(38, 0)),
        }
    )


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for ids, x in _blocks(batches, centroids.shape[1]):
        home = nearest(x, centroids)
        far = exact_distances(x, centroids[home])
        far = pa.array([min(int(v), LARGEST) for v in far], pa.int64()) if far.dtype == object else pa.array(far)
        yield pa.RecordBatch.from_arrays([ids, pa.array(home, pa.int32()), far], names=["vec_id", "cluster", "distance"])


def move(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round; those without vectors stay."""
    sums = kept.mapInArrow(partial(_sums, centroids=centroids), "cluster int, part int, n long, total decimal(38,0)")
    added = sums.groupBy("cluster", "part").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    moved = centroids.copy()
    for r in added.collect():  # k * dimensions rows at most
        moved[r["cluster"], r["part"]] = int(r["total"]) // r["n"]
    return moved


def cluster(table: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) and the final centroids."""
    kept = materialise(kept_vectors(table, dimensions, scale))
    start = first_centroids(kept, k)
    kind = dict(kept.dtypes)["vec_id"]
    if not start:
        return kept.selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256"), np.zeros((0, dimensions), np.int64)
    centroids = np.array(start, np.int64)
    for _ in range(rounds):
        centroids = move(kept, centroids)
    homes = materialise(kept.mapInArrow(partial(_assigned, centroids=centroids), f"vec_id {kind}, cluster int, distance long"))
    total = {r["cluster"]: int(r["total"]) for r in homes.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = [(c, min(t, LARGEST), min(sum(total.values()), LARGEST), digest[c]) for c, t in sorted(total.items())]
    told = kept.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return homes.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids  # k rows


def op11_centroids(spark, sf_dir):
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]


def _oracle() -> str:
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""d{r} AS MATERIALIZED (SELECT v.row, c.cluster, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS distance FROM v JOIN c{r} c USING (part) GROUP BY 1, 2),
a{r} AS MATERIALIZED (SELECT row, arg_min(cluster, distance * {CLUSTERS}::HUGEINT + cluster) AS cluster, min(distance) AS distance FROM d{r} GROUP BY 1)""")
        if r < ROUNDS:
            steps.append(f"""s{r} AS (SELECT a.cluster, v.part, sum(v.x) AS total, count(*) AS n FROM v JOIN a{r} a USING (row) GROUP BY 1, 2),
c{r + 1} AS MATERIALIZED (SELECT c.cluster, c.part, coalesce((s.total - ((s.total % s.n) + s.n) % s.n) // s.n, c.x)::BIGINT AS x FROM c{r} c LEFT JOIN s{r} s USING (cluster, part))""")
    last = ROUNDS
    return f"""
WITH k AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x, row_number() OVER () AS row FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
v AS MATERIALIZED (SELECT row, unnest(range({DIMENSIONS})) AS part, unnest(x) AS x FROM k),
f AS (SELECT x, row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS cluster FROM k QUALIFY cluster < {CLUSTERS}),
c0 AS MATERIALIZED (SELECT cluster, unnest(range({DIMENSIONS})) AS part, unnest(x) AS x FROM f),
{", ".join(steps)},
h AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY part)) AS centroid_sha256 FROM c{last} GROUP BY 1)
SELECT k.vec_id, a.cluster::INT AS cluster, a.distance, (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
       (sum(a.distance) OVER ())::BIGINT AS inertia, h.centroid_sha256 FROM a{last} a JOIN k USING (row) JOIN h USING (cluster)
"""


ORACLE = _oracle()
