"""Snapshots of pages with a tree of hashes, compared from the root down.

Pages lie in 2^bits leaves by the first bits of their slug's hash, a folder each.
A summary of a leaf is its number of pages and 128 bits over all of its slugs and
content hashes; a node above sums up FAN_BITS more bits, the root is level 0. Two
snapshots are compared level by level, always below differing nodes only; equal
subtrees are never looked into, and of the pages only those in differing leaves
are read and joined. The work follows what has changed, not the corpus, up to the
pages that share a leaf with a changed one.

Snapshots of different bits are compared at the coarser ones. On the driver there
are numbers of differing nodes, 2^bits at most.

Defined results: one row a slug; a null slug is one like any other; a null hash
equals a null hash; an empty snapshot has a root without pages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS, FAN_BITS, MOST_BITS = 8, 4, 16
SUMMARY = "level int, node int, n long, a long, b long"


def leaf_of(bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.col("slug").cast("string")), 64 - bits).cast("int") if bits else F.lit(0)


@dataclass
class Snapshot:
    """A snapshot's folder as written: pages by leaf, summaries of all levels."""

    spark: SparkSession
    folder: str
    schema: str
    bits: int

    def pages(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, leaf int").parquet(f"{self.folder}/pages")

    def summary(self) -> DataFrame:
        return self.spark.read.schema(SUMMARY).parquet(f"{self.folder}/summary")

    def count(self) -> int:
        root = self.summary().filter("level = 0").first()
        return root.n if root else 0


def write(pages: DataFrame, folder: str, bits: int = BITS) -> Snapshot:
    """slug, hash as a snapshot. Choose about as many leaves as thousands of pages."""
    if bits % FAN_BITS or not 0 <= bits <= MOST_BITS:
        raise ValueError(f"bits must be a multiple of {FAN_BITS} up to {MOST_BITS}")
    rows = pages.select("slug", "hash").withColumn("leaf", leaf_of(bits))
    rows.hint("rebalance", "leaf").write.partitionBy("leaf").parquet(f"{folder}/pages")
    kind = dict(pages.dtypes)
    out = Snapshot(pages.sparkSession, folder, f"slug {kind['slug']}, hash {kind['hash']}", bits)
    mixed = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), F.col("slug").cast("string"), F.col("slug").isNull(), "hash", F.col("hash").isNull()))
    leaves = out.pages().groupBy("leaf").agg(F.count("*").alias("n"), mixed(1).alias("a"), mixed(2).alias("b"))
    # every leaf is part of one node of each level
    up = [F.struct(F.lit(k // FAN_BITS).alias("level"), F.shiftrightunsigned("leaf", bits - k).alias("node")) for k in range(0, bits + 1, FAN_BITS)]
    nodes = leaves.withColumn("at", F.explode(F.array(*up))).groupBy("at.level", "at.node").agg(F.sum("n").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    nodes.select(*[F.col(c.split(" ")[0]).cast(c.split(" ")[1]) for c in SUMMARY.split(", ")]).repartitionByRange("level", "node").sortWithinPartitions("level", "node").write.parquet(f"{folder}/summary")
    return out


def differing(prior: Snapshot, fresh: Snapshot) -> tuple[int, list[int]]:
    """(bits, nodes of that many bits whose pages are not the same in both)."""
    bits, nodes = min(prior.bits, fresh.bits), [0]
    for level in range(bits // FAN_BITS + 1):
        below = (F.col("level") == level) & (F.shiftrightunsigned("node", FAN_BITS).isin(nodes) if level else F.lit(True))
        p, f = (s.summary().filter(below).select("node", F.struct("n", "a", "b").alias(c)) for s, c in ((prior, "p"), (fresh, "f")))
        nodes = [r.node for r in p.join(f, "node", "full").filter(~F.col("p").eqNullSafe(F.col("f"))).select("node").collect()]
        if not nodes:
            break
    return bits, nodes


def _within(snapshot: Snapshot, bits: int, nodes: list[int]) -> Column:
    """Pages below the nodes, as a condition on the folders: others are not opened."""
    spread = snapshot.bits - bits
    return F.col("leaf").isin([(n << spread) + k for n in nodes for k in range(1 << spread)])


def _compared(prior: Snapshot, fresh: Snapshot, bits: int, nodes: list[int]) -> DataFrame:
    """slug, status of the pages below the nodes."""
    p, f = (s.pages().filter(_within(s, bits, nodes)).select(F.col("slug").alias(f"{c}_slug"), F.col("hash").alias(f"{c}_hash"), F.lit(True).alias(c)) for s, c in ((prior, "p"), (fresh, "f")))
    same = F.col("p_hash").eqNullSafe(F.col("f_hash"))
    status = F.when(F.col("p").isNull(), "added").when(F.col("f").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return p.join(f, F.col("p_slug").eqNullSafe(F.col("f_slug")), "full").select(F.coalesce("p_slug", "f_slug").alias("slug"), status.alias("status"))


def changes(prior: Snapshot, fresh: Snapshot) -> DataFrame:
    """slug, status of the pages that were added, changed or removed."""
    return _compared(prior, fresh, *differing(prior, fresh)).filter("status <> 'unchanged'")


def diff(prior: Snapshot, fresh: Snapshot) -> DataFrame:
    """slug, status of all pages; those of equal leaves are listed from one side, without a join."""
    bits, nodes = differing(prior, fresh)
    same = fresh.pages().filter(~_within(fresh, bits, nodes)).select("slug", F.lit("unchanged").alias("status"))
    return _compared(prior, fresh, bits, nodes).unionByName(same)


def changed_fraction(prior: Snapshot, fresh: Snapshot) -> float:
    """Added, changed and removed over prior pages, by the summaries' counts; 1 without prior pages."""
    before = prior.count()
    return changes(prior, fresh).count() / before if before else 1.0
