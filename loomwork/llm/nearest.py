"""Approximate nearest neighbours by cosine: balanced posting lists around centroids.

Centroids are fitted on a bounded sample (SAMPLE rows by hash of the id) with a
penalty on crowded ones. They are few enough to hold in memory (LISTS at most),
in a graph of near neighbours that a best-first search walks. Every vector goes
to its nearest list and, near a boundary, to further lists up to REPLICAS. A
query reads the lists whose distance is within a ratio of its nearest one's, as
far as its beam reaches. Ratio and beam are read off the sample: for some of its
rows the true neighbours in it are known, and so is how far out their lists lie.
A sample has fewer vectors and so farther neighbours than the whole, which errs
towards more lists.

Lists over BLOCK vectors are read in blocks, and so are a list's queries, so no
task holds a whole list. Scores are computed in double precision on the original
vectors, in one order of summation, so equal vectors have equal scores.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite parts take no part; the largest finite parts do (vectors
are scaled by powers of two, which changes no cosine); equal ids count once, with
their best score; a query with fewer candidates gets all of them; no valid vector: no
rows; other columns are not used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import settle

#: Rows that centroids are fitted on, at most.
SAMPLE = 20_000
#: Vectors aimed at for each centroid, and centroids at most.
PER_LIST = 100
LISTS = 4096
#: A vector is copied to lists within this ratio of its nearest one's distance.
COPY_RATIO = 1.15
REPLICAS = 4
#: Rows of the sample whose true neighbours tell how many lists to read, the share of these to be found, and lists read anyway.
PROBES = 512
FOUND = 0.97
LEAST_LISTS = 16
BLOCK = 4096
NEIGHBOURS = 24


class Centroids:
    """Unit centroids and their neighbour graph."""

    def __init__(self, points: np.ndarray):
        self.points = np.ascontiguousarray(points, np.float32)
        n = len(points)
        m = min(NEIGHBOURS, max(n - 1, 0))
        near = np.zeros((n, m), np.int32)
        for a in range(0, n, 1024):
            s = self.points[a : a + 1024] @ self.points.T
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -9
            if m:
                near[a : a + 1024] = np.argsort(-s, axis=1, kind="stable")[:, :m]
        # a few far links keep the graph in one piece
        rng = np.random.default_rng(3)
        self.near = np.concatenate([near, rng.integers(0, n, (n, min(8, n))).astype(np.int32)], axis=1)
        self.entry = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int64))

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(lists, cosines) of the ``beam`` nearest centroids found for each row, nearest first."""
        n, rows = len(self.points), np.arange(len(x))[:, None]
        beam = min(beam, n)
        seen = np.zeros((len(x), n), bool)
        ids = np.tile(self.entry, (len(x), 1))
        seen[:, self.entry] = True
        sims = x @ self.points[self.entry].T
        done = np.zeros(ids.shape, bool)
        wide = 4  # nodes expanded at a time
        while True:
            rank = np.where(done, -9.0, sims)
            pick = np.argsort(-rank, axis=1, kind="stable")[:, :wide]
            open_ = np.take_along_axis(rank, pick, 1) > -9
            if not open_.any():
                break
            nodes = np.take_along_axis(ids, pick, 1)
            np.put_along_axis(done, pick, True, 1)
            new = self.near[nodes].reshape(len(x), -1)
            fresh = ~seen[rows, new] & np.repeat(open_, self.near.shape[1], axis=1)
            order = np.argsort(new, axis=1, kind="stable")
            inorder = np.take_along_axis(new, order, 1)
            same = np.zeros(new.shape, bool)
            same[:, 1:] = inorder[:, 1:] == inorder[:, :-1]
            again = np.zeros(new.shape, bool)
            np.put_along_axis(again, order, same, 1)
            fresh &= ~again
            r, c = np.nonzero(fresh)
            s = np.full(new.shape, -9.0, np.float32)
            s[r, c] = np.einsum("ij,ij->i", x[r], self.points[new[r, c]])
            seen[r, new[r, c]] = True
            ids = np.concatenate([ids, new], axis=1)
            sims = np.concatenate([sims, s], axis=1)
            done = np.concatenate([done, ~fresh], axis=1)
            top = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
            ids, sims, done = (np.take_along_axis(v, top, 1) for v in (ids, sims, done))
        return ids, sims


def fit(sample: np.ndarray, lists: int, rounds: int = 10, crowd: float = 0.05, seed: int = 1) -> Centroids:
    """Spherical k-means whose assignment costs more the more vectors a centroid has."""
    rng = np.random.default_rng(seed)
    x = (sample / np.linalg.norm(sample, axis=1, keepdims=True)).astype(np.float32)
    lists = min(lists, len(x))
    c = x[rng.choice(len(x), lists, replace=False)].copy()
    load = np.full(lists, len(x) / lists)
    for _ in range(rounds):
        penalty = (crowd * np.log((load + 1) / (len(x) / lists + 1))).astype(np.float32)
        at = np.concatenate([(x[a : a + 2048] @ c.T - penalty).argmax(1) for a in range(0, len(x), 2048)])
        load = np.bincount(at, minlength=lists).astype(float)
        sums = np.zeros(c.shape)
        np.add.at(sums, at, x)
        size = np.linalg.norm(sums, axis=1)
        full = (load > 0) & (size > 0)
        c[full] = (sums[full] / size[full, None]).astype(np.float32)
        c[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return Centroids(c)


def distance(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * cosines))


def reach(c: Centroids, sample: np.ndarray, k: int = 5, seed: int = 2) -> tuple[float, int]:
    """(ratio, beam) that a query needs so as to read FOUND of its k nearest in the sample."""
    x = (sample / np.linalg.norm(sample, axis=1, keepdims=True)).astype(np.float32)
    if len(x) <= k:
        return 9.0, len(c.points)
    q = np.random.default_rng(seed).choice(len(x), min(PROBES, len(x)), replace=False)
    sims = x[q] @ x.T
    sims[np.arange(len(q)), q] = -9
    near = np.argpartition(-sims, k, axis=1)[:, :k]
    far = distance(x[q] @ c.points.T)
    ordered = np.sort(far, axis=1)
    lists, own = _placed(c, x[near.ravel()])
    out = np.where(own, far[np.repeat(np.arange(len(q)), k)[:, None], lists], 9.0).min(axis=1).reshape(len(q), k)
    ranks = (ordered[:, None, :] < out[:, :, None] - 1e-7).sum(axis=2) + 1
    beam = int(np.quantile(ranks, FOUND, method="higher"))
    return float(np.quantile(out / np.maximum(ordered[:, :1], 1e-9), 1 - (1 - FOUND) / 3)), max(beam, LEAST_LISTS)


def _placed(c: Centroids, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lists, which of them hold a copy) of each unit row."""
    ids, sims = c.search(x, 2 * REPLICAS)
    d = distance(sims)
    return ids, (sims > -9) & (d <= d[:, :1] * COPY_RATIO + 1e-9) & (np.arange(ids.shape[1]) < REPLICAS)


def _matrix(column, dims: int) -> np.ndarray:
    """Rows scaled by powers of two, so that no norm overflows or vanishes."""
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)
    e = np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None]
    half = e // 2  # in two steps, as one power alone may not be a number
    return x * 2.0 ** -half.astype(np.float64) * 2.0 ** -(e - half).astype(np.float64)


def search(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & v.isNotNull()).filter(fine)
    shape = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if shape is None:
        return empty
    dims, n = shape["d"], shape["count"]
    rows = rows.filter(F.size("v") == dims)
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    sample = _matrix(pa.array(picked.v.tolist(), pa.list_(pa.float64())), dims)
    centroids = fit(sample, max(1, min(LISTS, n // PER_LIST)))
    model = spark.sparkContext.broadcast((centroids, *reach(centroids, sample, k)))

    def place(batches, reading: bool):
        c, ratio, beam = model.value
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                x = _matrix(part.column(1), dims)
                x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
                if reading:
                    ids, sims = c.search(x, beam)
                    d = distance(sims)
                    ok = (sims > -9) & ((d <= d[:, :1] * ratio + 1e-9) | (np.arange(ids.shape[1]) < LEAST_LISTS))
                else:
                    ids, ok = _placed(c, x)
                r, k_ = np.nonzero(ok)
                yield pa.RecordBatch.from_arrays([pa.array(ids[r, k_].astype(np.int32)), part.column(0).take(pa.array(r)), part.column(1).take(pa.array(r))], names=["list", "id", "v"])

    schema = "list int, id long, v array<double>"
    posted = rows.mapInArrow(lambda it: place(it, False), schema)
    asked = rows.filter(F.col("id") % every == 0).mapInArrow(lambda it: place(it, True), schema)
    # At most LISTS rows each: how many blocks a list and its queries need.
    sizes = posted.groupBy("list").count().select("list", F.ceil(F.col("count") / BLOCK).cast("int").alias("pn"))
    loads = asked.groupBy("list").count().select("list", F.ceil(F.col("count") / BLOCK).cast("int").alias("qn"))
    plan = F.broadcast(settle(sizes.join(loads, "list")))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    left = posted.join(plan, "list").withColumn("pb", own("pn")).withColumn("qb", upto("qn")).select("list", "pb", "qb", "id", "v")
    right = asked.join(plan, "list").withColumn("qb", own("qn")).withColumn("pb", upto("pn")).select("list", "pb", "qb", "id", "v")

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        x, y = _matrix(b.column("v").combine_chunks(), dims), _matrix(a.column("v").combine_chunks(), dims)
        qid, vid = b.column("id").to_numpy(), a.column("id").to_numpy()
        s = np.einsum("qd,nd->qn", x, y) / (np.sqrt(np.einsum("qd,qd->q", x, x))[:, None] * np.sqrt(np.einsum("nd,nd->n", y, y)))
        s[qid[:, None] == vid[None, :]] = -9
        # in order of ids, each once with its best score
        order = np.argsort(vid, kind="stable")
        vid, first = np.unique(vid[order], return_index=True)
        s = np.maximum.reduceat(s[:, order], first, axis=1)
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        r, t = np.repeat(np.arange(len(qid)), top.shape[1]), top.ravel()
        ok = s[r, t] > -9
        return pa.table({"query_id": qid[r[ok]], "vec_id": vid[t[ok]], "score": s[r[ok], t[ok]]})

    keys = ["list", "pb", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
