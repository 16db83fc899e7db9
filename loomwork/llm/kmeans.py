"""Centroid clustering in whole numbers, with Exponion search.

Every vector keeps its cluster, an upper bound of the distance to its centroid
and a lower bound of the distance to all others. A round moves the bounds by how
far centroids moved. Where they do not settle that the cluster stays, the upper
bound is made exact; where that does not settle it either, only centroids inside
a ball around the own centroid are looked at, those within twice the upper bound
plus the distance from the own centroid to its nearest neighbour: in each
centroid's list of the others, sorted by distance, a prefix. The ball holds the
nearest and the second nearest centroid. It includes its surface, and bounds
settle nothing where they are equal, so that ties reach the comparison.

Distances that decide are squared and whole, hence exact; bounds are doubles,
rounded away from settling anything.

A round is one pass over the vectors, with the centroids sent along: their
number is a parameter. Each task's sums travel as one row a cluster. Vectors and
bounds are written once a round and the round before is deleted.

Defined results: vectors that are null, of another length, or hold nulls, NaN or
infinities take no part; components count up to 2^27 (after scaling) on either
side, larger ones as that, so that squared distances fit; rows with one id or
none are vectors of their own, those without an id are the last to be starting
centroids; fewer vectors than clusters give fewer clusters; of equal centroids
the first has all vectors; a sum that does not fit a long is null; an empty table
gives none; other columns are not used.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import drop_stored, stored

CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 16, 3, 64, 64, 1
#: Components beyond this count as this: 64 squares of differences fit a long.
MOST = 1 << 27
#: Bounds are widened by this share, which is far more than doubles are wrong by.
WIDER = 1e-12
STATE = "vec_id long, x array<int>, cluster int, upper double, lower double"


# --- the search in one batch ----------------------------------------------------


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row."""
    d = x - c
    return np.einsum("nd,nd->n", d, d)


def above(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 + WIDER)


def below(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 - WIDER)


class Lists:
    """For each centroid: all others, nearest first, and their distances, rounded down."""

    def __init__(self, centroids: np.ndarray):
        self.c, k = centroids, len(centroids)
        d2 = np.array([squared(centroids, np.broadcast_to(c, centroids.shape)) for c in centroids]).reshape(k, k)
        order = np.array([np.argsort(np.where(np.arange(k) == j, -1, d2[j]), kind="stable")[1:] for j in range(k)], np.int64)
        self.order = order.reshape(k, k - 1)
        near = np.take_along_axis(d2, self.order, axis=1)
        self.dist, self.next = below(near), above(near[:, 0]) if k > 1 else np.zeros(k)

    def full(self, x: np.ndarray):
        """(cluster, upper, lower) without anything known: all centroids."""
        n = len(x)
        best, at, second = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64), np.full(n, np.inf)
        for j, c in enumerate(self.c):
            d = squared(x, c[None, :])
            closer = d < best  # of equals the smaller number stays
            second = np.minimum(second, np.where(closer, best, d).astype(np.float64))
            at, best = np.where(closer, j, at), np.where(closer, d, best)
        if len(self.c) == 1:
            second[:] = np.inf
        return at, above(best), below(second)

    def search(self, x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        """(cluster, upper, lower, distances worked out) from bounds that hold for these centroids."""
        at, upper, lower = at.copy(), upper.copy(), lower.copy()
        if len(self.c) == 1:
            return at, upper, lower, 0
        settled = np.maximum(lower, self.dist[at, 0] / 2)
        open_ = np.flatnonzero(upper >= settled)
        own = squared(x[open_], self.c[at[open_]])
        upper[open_], worked = above(own), len(open_)
        still = upper[open_] >= settled[open_]
        rows, best = open_[still], own[still]
        a = at[rows]
        inside = (self.dist[a] <= (2 * upper[rows] + self.next[a])[:, None]).sum(axis=1)
        now, second = a.copy(), np.full(len(rows), np.inf)
        for p in range(int(inside.max()) if len(rows) else 0):
            some = np.flatnonzero(inside > p)
            j = self.order[a[some], p]
            d = squared(x[rows[some]], self.c[j])
            worked += len(some)
            closer = (d < best[some]) | (d == best[some]) & (j < now[some])
            second[some] = np.minimum(second[some], np.where(closer, best[some], d).astype(np.float64))
            best[some], now[some] = np.where(closer, d, best[some]), np.where(closer, j, now[some])
        at[rows], upper[rows], lower[rows] = now, above(best), below(second)
        return at, upper, lower, worked


def moved(before: np.ndarray, after: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray):
    """The bounds once centroids have moved."""
    step = above(squared(before, after))
    order = np.argsort(-step, kind="stable")
    most = np.where(np.arange(len(step)) == order[0], step[order[1]] if len(step) > 1 else 0.0, step[order[0]])
    return (upper + step[at]) * (1 + WIDER), np.maximum((lower - most[at]) * np.where(lower > most[at], 1 - WIDER, 1.0), 0.0)


# --- rounds over a table ----------------------------------------------------------


def whole_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, x: the vectors that take part, in whole numbers."""
    v = F.col(vector_col)
    good = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    part = F.coalesce((F.size(v) == dims) & F.forall(v, good), F.lit(False))
    scaled = lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int")
    return vectors.filter(part).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, scaled).alias("x"))


def starts(kept: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the least hashes of seed and id, in their order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(key.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(clusters).collect()
    return np.array([r.x for r in rows], np.int64)


def _x(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().astype(np.int64).reshape(-1, dims)


def _round(state: DataFrame, dims: int, before: np.ndarray | None, centroids: np.ndarray) -> DataFrame:
    """Every vector's cluster and bounds for these centroids; ``before``: those that the given bounds are of."""
    first = before is None

    def run(batches):
        lists = Lists(centroids)
        for batch in batches:
            x = _x(batch, dims)
            if first:
                at, upper, lower = lists.full(x)
            else:
                at = batch.column("cluster").to_numpy().astype(np.int64)
                upper, lower = moved(before, centroids, at, batch.column("upper").to_numpy(), batch.column("lower").to_numpy())
                at, upper, lower, _ = lists.search(x, at, upper, lower)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(at.astype(np.int32)), pa.array(upper), pa.array(lower)], names=[c.split(" ")[0] for c in STATE.split(", ")])

    return state.mapInArrow(run, STATE)


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each cluster's sum over its count, rounded down; empty clusters keep their centroid. One row a cluster comes to the driver."""
    dims = centroids.shape[1]
    sums = [F.sum(F.col("x")[i].cast("long")).alias(f"x{i}") for i in range(dims)]
    out = centroids.copy()
    for r in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        out[r.cluster] = [r[f"x{i}"] // r.n for i in range(dims)]
    return out


def _final(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    dims = centroids.shape[1]

    def run(batches):
        for batch in batches:
            at = batch.column("cluster")
            d = squared(_x(batch, dims), centroids[at.to_numpy()])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), at, pa.array(d)], names=["vec_id", "cluster", "distance"])

    return state.mapInArrow(run, "vec_id long, cluster int, distance long")


def _fits(n: int) -> int | None:
    return n if n < 1 << 63 else None


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row for each vector that takes part."""
    spark = vectors.sparkSession
    kept = whole_vectors(vectors, dims, scale, id_col, vector_col)
    now = starts(kept, clusters, seed)
    if not len(now):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    state, before = kept, None
    for k in range(rounds + 1):
        state, old = stored(_round(state, dims, before, now), "clusters"), state
        drop_stored(old)
        before, now = now, _means(state, now) if k < rounds else now
    found = stored(_final(state, now), "clustered")
    drop_stored(state)
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # one row a cluster
    named = [(c, _fits(s), hashlib.sha256(",".join(map(str, now[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    told = spark.createDataFrame(named, "cluster int, cluster_inertia long, centroid_sha256 string").withColumn("inertia", F.lit(_fits(sum(sums.values()))).cast("long"))
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
