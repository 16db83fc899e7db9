"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import drop_stored, stored, stored_counted

#: The rounds grow with the logarithm of the longest path, so this is far beyond any table.
MOST_ROUNDS = 100
#: Links that one task joins by itself, at most: fewer than any exchange is worth.
FEW_LINKS = 10_000


def _joined(batches):
    """u, v: each node and the least one it is linked with, by union-find over a few links."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    rows = [(x, root(x)) for x in list(parent)]
    rows = [r for r in rows if r[0] != r[1]]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["u", "v"])


def _is_done(edges: DataFrame) -> bool:
    """Whether every node above has one edge and no node is both above and below."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def _contracted(edges: DataFrame) -> DataFrame:
    """One round of a large and a small star."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # large star: neighbours above a node go to the least of it and its neighbours
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    # small star: a node and its neighbours below go to the least of them
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return small.filter("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", few: int = FEW_LINKS) -> DataFrame:
    """node, component: the least node that can be reached, for every node that has a link.

    Least neighbours are summed up before they are shuffled and then joined, so
    a hub costs no more than others. Links that are counted and found ``few`` are
    joined in one task. The result reads one stored table, which drop_stored()
    deletes.
    """
    edges, n = stored_counted(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    for _ in range(MOST_ROUNDS):
        if n <= few:
            before, edges = edges, stored(edges.coalesce(1).mapInArrow(_joined, "u long, v long"), "edges")
            drop_stored(before)
            break
        if _is_done(edges):
            break
        before = edges
        edges, n = stored_counted(_contracted(edges), "edges")
        drop_stored(before)
    else:
        raise RuntimeError(f"components are not settled after {MOST_ROUNDS} rounds")
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out.scratch_path = edges.scratch_path
    return out
