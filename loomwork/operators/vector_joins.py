"""Exact joins of two tables of vectors by dot product, by bounds between blocks.

Vectors are sorted by their nearest pivot and their distance to it, in one range
sort, and cut into blocks of BLOCK rows; a block is one row, with its centre, its
radius, its largest norm and, for each pivot, the range of its vectors' distances
to it. Each block of queries first meets the few blocks whose centres are nearest
to its own. What it finds there gives every query a score that its k-th best has
at least. By the triangle inequality no product of a query with a block is over

- the query's product with the centre plus its norm times the radius,
- half of both squared norms less the squared distance, which is at least as long
  as the query's distance to any pivot is outside of the block's range,

so blocks whose bound is under what each of the queries already has, or under the
asked score, are never joined. All others are, in tiles of blocks, so the result is
that of comparing all with all. How many pairs are left depends on the vectors:
where they form groups few are, where they are spread evenly over many dimensions
all.

Neither vectors nor blocks are gathered or broadcast: bounds are worked out
between GROUP blocks of queries and CHUNK block summaries that meet by key. The
pivots come from a sample of SAMPLE rows at most. What is written on the way goes
once the result is.

Defined results: rows without an id, and vectors that are null or empty, or hold
nulls, NaN or infinities take no part, and queries like that have no rows; vectors
of another length are never near; ties go to the smaller id; of ``vectors``, rows
with one id are vectors of their own; queries with one id share its k rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.runtime import discard, kept

#: Rows of a block; blocks of queries and block summaries that one task compares; pivots and the rows that they are chosen from.
BLOCK, GROUP, CHUNK, PIVOTS, SAMPLE = 1024, 32, 4096, 16, 2048
#: Blocks of either side that one task joins at once: two times TILE blocks in memory, and as many times fewer copies of each.
TILE = 16
#: Blocks that a block of queries meets first.
FIRST = 2
#: Up to so many pairs of blocks all are joined: bounds would cost more than they spare.
FEW_PAIRS = 16
#: By what share products are taken to be off in doubles.
SLACK = 1e-9

PACKED = "block long, dims int, n int, ids binary, rows binary, centre array<double>, radius double, norm double, low array<double>, high array<double>"


@dataclass
class Plan:
    """What a join did: block pairs there are, and pairs that were joined."""

    pairs: int = 0
    joined: int = 0

    @property
    def share(self) -> float:
        return self.joined / self.pairs if self.pairs else 0.0


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v: the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.coalesce((F.size("v") > 0) & F.forall("v", finite), F.lit(False)))


def choose_pivots(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each length: pivots of the sample that lie far from each other, one after the other."""
    rows = vectors.withColumn("_h", F.xxhash64("id", "v")).orderBy("_h").limit(SAMPLE).collect()
    by_dims: dict[int, list] = {}
    for r in rows:
        by_dims.setdefault(len(r.v), []).append(r.v)
    out = {}
    for dims, found in by_dims.items():
        x = np.array(found)
        at = [0]
        far = np.linalg.norm(x - x[0], axis=1)
        while len(at) < min(PIVOTS, len(x)) and far.max() > 0:
            at.append(int(far.argmax()))
            far = np.minimum(far, np.linalg.norm(x - x[at[-1]], axis=1))
        out[dims] = x[at]
    return out


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ends, values) of an Arrow array of lists."""
    return np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy())]), column.flatten().to_numpy(zero_copy_only=False)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.linalg.norm(x[:, None, :] - pivots[None], axis=2)


def packed_blocks(vectors: DataFrame, pivots: dict[int, np.ndarray], rows: int = BLOCK) -> DataFrame:
    """The vectors of usable() in blocks of at most ``rows`` neighbours, one row each."""
    none = np.zeros((0, 1))

    def near(batches):
        for batch in batches:
            ends, values = _lists(batch.column("v"))
            n = batch.num_rows
            cell, far = np.zeros(n, np.int32), np.zeros(n)
            size = np.diff(ends)
            for dims in np.unique(size):
                some = np.flatnonzero(size == dims)
                own = pivots.get(int(dims), none)
                if len(own):
                    d = _distances(values[ends[some][:, None] + np.arange(dims)], own)
                    cell[some], far[some] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(size.astype(np.int32)), pa.array(cell), pa.array(far)], names=["id", "v", "dims", "cell", "far"])

    def pack(batches):
        part, at, held, held_dims = TaskContext.get().partitionId(), 0, [], None

        def block():
            nonlocal at, held
            ids, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            own = pivots.get(x.shape[1], none)
            d = _distances(x, own) if len(own) else np.zeros((len(x), 0))
            centre = x.mean(0)
            row = [(part << 33) + at, x.shape[1], len(x), ids.astype("<i8").tobytes(), x.astype("<f8").tobytes(), centre.tolist(), float(np.linalg.norm(x - centre, axis=1).max()), float(np.linalg.norm(x, axis=1).max()), d.min(0).tolist(), d.max(0).tolist()]
            at, held = at + 1, []
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=[c.split(" ")[0] for c in PACKED.split(", ")])

        for batch in batches:
            ends, values = _lists(batch.column("v"))
            ids, size, a = batch.column("id").to_numpy(), batch.column("dims").to_numpy(), 0
            while a < len(ids):
                if held and (held_dims != size[a] or sum(len(h[0]) for h in held) >= rows):
                    yield block()
                held_dims = size[a]
                same = np.flatnonzero(size[a:] != held_dims)
                b = min(a + (int(same[0]) if len(same) else len(ids) - a), a + rows - sum(len(h[0]) for h in held))
                held.append((ids[a:b], values[ends[a] : ends[b]].reshape(b - a, held_dims)))
                a = b
        if held:
            yield block()

    keys = ["dims", "cell", "far", "id"]
    sorted_ = vectors.mapInArrow(near, "id long, v array<double>, dims int, cell int, far double").repartitionByRange(*keys).sortWithinPartitions(*keys)
    return kept(sorted_.mapInArrow(pack, PACKED), "blocks")


def _matrix(table: pa.Table, i: int = 0) -> tuple[np.ndarray, np.ndarray]:
    dims = table.column("dims")[i].as_py()
    return np.frombuffer(table.column("ids")[i].as_py(), "<i8"), np.frombuffer(table.column("rows")[i].as_py(), "<f8").reshape(-1, dims)


def best_in_block(qi: np.ndarray, x: np.ndarray, vi: np.ndarray, y: np.ndarray, k: int, least: np.ndarray, exclude_self: bool):
    """(row of x, row of y, score): for each query its k best that reach ``least``; equal vectors have equal scores."""
    s = x @ y.T
    if exclude_self:
        s[qi[:, None] == vi[None, :]] = -np.inf
    slack = SLACK * (1 + np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * x.shape[1])
    floor = least - slack
    if s.shape[1] > k:
        floor = np.maximum(floor, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - slack)
    r, c = np.nonzero((s >= floor[:, None]) & (s > -np.inf))
    # products in one fixed order of summation decide, so that copies tie whatever their place
    score = np.einsum("nd,nd->n", x[r], y[c])
    order = np.lexsort((vi[c], -score, r))
    r, c, score = r[order], c[order], score[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    keep = (rank < k) & (score >= least[r])
    return r[keep], c[keep], score[keep]


def _bounds(x: np.ndarray, blocks: pa.Table, pivots: np.ndarray | None) -> np.ndarray:
    """For each query and block: what no product is over."""
    dims, n = x.shape[1], blocks.num_rows
    centre = blocks.column("centre").combine_chunks().flatten().to_numpy().reshape(n, dims)
    radius, norm = blocks.column("radius").to_numpy(), blocks.column("norm").to_numpy()
    size = np.linalg.norm(x, axis=1)
    ball = x @ centre.T + size[:, None] * radius[None]
    low, high = (blocks.column(c).combine_chunks().flatten().to_numpy().reshape(n, -1) for c in ("low", "high"))
    out = np.minimum(ball, size[:, None] * norm[None])
    if pivots is not None:
        d = _distances(x, pivots)
        outside = np.zeros_like(out)
        for p in range(len(pivots)):
            outside = np.maximum(outside, np.maximum(d[:, p : p + 1] - high[None, :, p], low[None, :, p] - d[:, p : p + 1]))
        out = np.minimum(out, (size[:, None] ** 2 + norm[None] ** 2 - outside**2) / 2)
    return out + SLACK * (1 + np.abs(out))


FOUND = "qb long, query_id long, id long, score double"


def _tile(block: str) -> Column:
    """The first of TILE blocks that follow each other in one part of the sort."""
    return F.col(block) - (F.col(block) % (1 << 33)) % TILE


def _join_pairs(pairs: DataFrame, queries: DataFrame, blocks: DataFrame, k: int, exclude_self: bool, least: float, floors: DataFrame | None = None) -> DataFrame:
    """The best of each pair of blocks. Pairs meet in tiles of TILE blocks by TILE, so that a block travels once for each tile that
    wants it, not for each pair. floors: for each block of queries the scores that its queries have already."""
    tiled = pairs.withColumn("qt", _tile("qb")).withColumn("vt", _tile("vb"))
    left = tiled.groupBy("qb", "qt", "vt").agg(F.collect_list("vb").alias("vbs")).join(queries.select(F.col("block").alias("qb"), "dims", "ids", "rows"), "qb")
    left = left.join(floors, "qb", "left") if floors is not None else left.withColumn("floor", F.lit(None).cast("binary"))
    # names of their own: both sides come from one table of pairs
    other = tiled.select(F.col("qt").alias("_qt"), F.col("vt").alias("_vt"), F.col("vb").alias("_vb")).distinct()
    right = other.join(blocks.select(F.col("block").alias("_vb"), "dims", "ids", "rows"), "_vb")

    def join(a: pa.Table, b: pa.Table) -> pa.Table:
        place = {vb: i for i, vb in enumerate(b.column("_vb").to_pylist())} if b.num_rows else {}
        out = [pa.table({"qb": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})]
        for i in range(a.num_rows):
            qi, x = _matrix(a, i)
            floor = a.column("floor")[i].as_py()
            own = np.maximum(np.frombuffer(floor, "<f8"), least) if floor is not None else np.full(len(qi), least)
            rows, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for vb in a.column("vbs")[i].as_py():
                vi, y = _matrix(b, place[vb])
                r, c, score = best_in_block(qi, x, vi, y, k, own, exclude_self)
                rows, ids, scores = np.concatenate([rows, r]), np.concatenate([ids, vi[c]]), np.concatenate([scores, score])
            order = np.lexsort((ids, -scores, rows))
            rows, ids, scores = rows[order], ids[order], scores[order]
            best = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
            out.append(pa.table({"qb": np.full(int(best.sum()), a.column("qb")[i].as_py(), np.int64), "query_id": qi[rows[best]], "id": ids[best], "score": scores[best]}))
        return pa.concat_tables(out)

    return left.groupBy("qt", "vt").cogroup(right.groupBy("_qt", "_vt")).applyInArrow(join, FOUND)


def _floors(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qb, floor: the k-th score that each query of a block has, in the block's order; the least number where it has fewer."""
    per = found.groupBy("qb", "query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"), F.count("*").alias("n"))
    kth = per.filter(F.col("n") >= k).select("qb", "query_id", F.element_at("s", F.lit(k)).alias("kth"))

    def join(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows:
            return pa.table({"qb": pa.array([], pa.int64()), "floor": pa.array([], pa.binary())})
        ids = np.frombuffer(a.column("ids")[0].as_py(), "<i8")
        out = np.full(len(ids), -np.inf)
        if b.num_rows:
            # rows with one id are one query here: the least score that one of them is sure of
            known, score = b.column("query_id").to_numpy(), b.column("kth").to_numpy()
            at = np.minimum(np.searchsorted(ids, known), len(ids) - 1)
            first = np.searchsorted(ids, ids)
            repeated = np.bincount(first, minlength=len(ids))[first] > 1
            out[at] = score
            out = np.where(repeated, -np.inf, out)
        return pa.table({"qb": pa.array([a.column("qb")[0].as_py()], pa.int64()), "floor": pa.array([out.astype("<f8").tobytes()], pa.binary())})

    return queries.select(F.col("block").alias("qb"), "ids").groupBy("qb").cogroup(kth.groupBy("qb")).applyInArrow(join, "qb long, floor binary")


def _against_summaries(queries: DataFrame, blocks: DataFrame, sizes: tuple[int, int], choose, schema: str) -> DataFrame:
    """``choose`` for each block of queries and each chunk of summaries of blocks of its length. sizes: how many blocks there are."""
    groups, chunks = -(-sizes[0] // GROUP), -(-sizes[1] // CHUNK)
    part = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    summaries = blocks.select("block", "dims", "centre", "radius", "norm", "low", "high", part(chunks).alias("chunk")).withColumn("group", every(groups))
    asked = queries.withColumn("group", part(groups)).withColumn("chunk", every(chunks))
    empty = pa.table({c.split(" ")[0]: pa.array([], pa.float64() if c.endswith("double") else pa.int64()) for c in schema.split(", ")})

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [empty]
        for i in range(a.num_rows):
            same = b.filter(pc.equal(b.column("dims"), a.column("dims")[i])) if b.num_rows else b
            if same.num_rows:
                out.append(choose(a.slice(i, 1), same))
        return pa.concat_tables(out)

    return asked.groupBy("group", "chunk").cogroup(summaries.groupBy("group", "chunk")).applyInArrow(run, schema)


def _nearest_blocks(a: pa.Table, b: pa.Table) -> pa.Table:
    centre = np.array(a.column("centre")[0].as_py())
    d = np.linalg.norm(b.column("centre").combine_chunks().flatten().to_numpy().reshape(b.num_rows, -1) - centre, axis=1)
    at = np.argsort(d, kind="stable")[:FIRST]
    return pa.table({"qb": np.full(len(at), a.column("block")[0].as_py(), np.int64), "vb": b.column("block").to_numpy()[at], "d": d[at]})


def topk_join(queries: DataFrame, vectors: DataFrame, k: int, query_id: str, id_col: str, vector_col: str = "embedding", exclude_self: bool = False, least: float = float("-inf"), block: int = BLOCK, few: int = FEW_PAIRS, plan: Plan | None = None) -> DataFrame:
    """query_id, rank, id, score: the k best of ``vectors`` for every query, exactly; only scores of at least ``least``."""
    right = usable(vectors, id_col, vector_col)
    pivots = choose_pivots(right)
    blocks = packed_blocks(right, pivots, block)
    asked = packed_blocks(usable(queries, query_id, vector_col), pivots, block)
    held = [{r.dims: r.n for r in x.groupBy("dims").agg(F.count("*").alias("n")).collect()} for x in (asked, blocks)]  # a row for each length
    plan = plan or Plan()
    plan.pairs = sum(n * held[1].get(dims, 0) for dims, n in held[0].items())
    if plan.pairs <= few:
        pairs = asked.select(F.col("block").alias("qb"), "dims").join(blocks.select(F.col("block").alias("vb"), "dims"), "dims").select("qb", "vb")
        plan.joined, found, used = plan.pairs, _join_pairs(pairs, asked, blocks, k, exclude_self, least), []
    else:
        sizes = tuple(sum(h.values()) for h in held)
        near = _against_summaries(asked.select("block", "dims", "centre"), blocks, sizes, _nearest_blocks, "qb long, vb long, d double")
        rank = F.row_number().over(Window.partitionBy("qb").orderBy("d", "vb"))
        first = kept(near.withColumn("r", rank).filter(F.col("r") <= FIRST).select("qb", "vb"), "first")
        begun = kept(_join_pairs(first, asked, blocks, k, exclude_self, least), "begun")
        floors = kept(_floors(begun, asked, k), "floors")

        def open_blocks(a: pa.Table, b: pa.Table) -> pa.Table:
            _, x = _matrix(a)
            have = np.maximum(np.frombuffer(a.column("floor")[0].as_py(), "<f8"), least)
            some = (_bounds(x, b, pivots.get(x.shape[1])) >= have[:, None]).any(axis=0)
            vb = b.column("block").to_numpy()[some]
            return pa.table({"qb": np.full(len(vb), a.column("block")[0].as_py(), np.int64), "vb": vb})

        with_floors = asked.select("block", "dims", "ids", "rows").join(floors.withColumnRenamed("qb", "block"), "block")
        left = _against_summaries(with_floors, blocks, sizes, open_blocks, "qb long, vb long")
        rest = kept(left.join(first, ["qb", "vb"], "left_anti"), "rest")
        plan.joined = first.count() + rest.count()
        found = begun.unionByName(_join_pairs(rest, asked, blocks, k, exclude_self, least, floors))
        used = [first, begun, floors, rest]
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
    out = kept(ranked.select("query_id", "rank", "id", "score"), "nearest")
    discard(blocks, asked, *used)
    return out


def search(blocks: DataFrame, q: Sequence[float], k: int, least: float = float("-inf")) -> DataFrame:
    """id, score: the k best rows of packed blocks for one vector. A task multiplies a block at a time, leaves out blocks that cannot
    reach what it has, and hands on k rows; blocks of another length, and a vector that is not finite, give none."""
    ask = np.array([float(x) for x in q])
    size = float(np.linalg.norm(ask)) if np.isfinite(ask).all() else float("nan")

    def run(batches):
        ids, scores, floor = np.zeros(0, np.int64), np.zeros(0), least
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("dims")[i].as_py() != len(ask) or not np.isfinite(size):
                    continue
                bound = float(np.array(batch.column("centre")[i].as_py()) @ ask) + size * batch.column("radius")[i].as_py()
                if bound + SLACK * (1 + abs(bound)) < floor:
                    continue
                vi, y = _matrix(pa.Table.from_batches([batch]), i)
                _, c, score = best_in_block(np.zeros(1, np.int64), ask[None], vi, y, k, np.array([floor]), False)
                ids, scores = np.concatenate([ids, vi[c]]), np.concatenate([scores, score])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                floor = max(floor, scores[k - 1]) if len(scores) >= k else floor
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(scores)], names=["id", "score"])

    columns = blocks.select("dims", "ids", "rows", "centre", "radius")
    return columns.mapInArrow(run, "id long, score double").orderBy(F.desc("score"), "id").limit(k)


def near_duplicates(vectors: DataFrame, threshold: float, id_col: str, vector_col: str = "embedding", **options) -> DataFrame:
    """Each vector's nearest neighbour, if it reaches the threshold (applied after top-1)."""
    return topk_join(vectors, vectors, 1, id_col, id_col, vector_col, exclude_self=True, least=threshold, **options).drop("rank")
