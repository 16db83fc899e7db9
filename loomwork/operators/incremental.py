"""Incremental maintenance: what changed, what is stale by it, what can be carried over."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A larger share of changed pages leads to a full rebuild.
REBUILD_ABOVE = 0.30


def diff_pages(prior: DataFrame, new: DataFrame) -> DataFrame:
    """slug, status (added, changed, unchanged, removed) from two tables of (slug, hash)."""
    p, n = prior.select("slug", F.col("hash").alias("_p")), new.select("slug", F.col("hash").alias("_n"))
    status = F.when(F.col("_p").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_p") == F.col("_n"), "unchanged").otherwise("changed")
    return p.join(n, "slug", "full").select("slug", status.alias("status"))


def touched(diff: DataFrame) -> DataFrame:
    """Slugs whose prior content is gone: changed or removed; added ones are not."""
    return diff.filter(F.col("status").isin("changed", "removed")).select("slug")


def changed_fraction(diff: DataFrame) -> DataFrame:
    """fraction: added, changed and removed over prior pages; 1 without prior pages."""
    prior = F.count_if(F.col("status") != "added")
    moved = F.count_if(F.col("status") != "unchanged")
    return diff.agg(F.when(prior > 0, moved / prior).otherwise(F.lit(1.0)).alias("fraction"))


def pages_needing_embed(pages: DataFrame, diff: DataFrame, prior_vectors: DataFrame) -> DataFrame:
    """Pages with content that are added, changed or have no vector yet. pages: slug, content_full."""
    from loomwork.operators.pages import nonblank

    have = prior_vectors.select("slug").distinct().withColumn("_has", F.lit(True))
    rows = nonblank(pages).select("slug").join(diff, "slug", "left").join(have, "slug", "left")
    return rows.filter(F.col("status").isin("added", "changed") | F.col("_has").isNull()).select("slug")


def stale_by_overlap(chunks: DataFrame, moved: DataFrame, key: str = "chunk_id", evidence: str = "evidence_slugs") -> DataFrame:
    """Chunks one of whose evidence pages was touched."""
    items = chunks.select(key, F.explode(evidence).alias("slug"))
    return items.join(moved, "slug", "left_semi").select(key).distinct()


def stale_by_drift(chunks: DataFrame, retrieved: DataFrame, key: str = "chunk_id", evidence: str = "evidence_slugs") -> DataFrame:
    """Chunks whose query finds other pages than those they were written from. retrieved: key, slug."""
    now = retrieved.groupBy(key).agg(F.array_sort(F.collect_set("slug")).alias("_now"))
    joined = chunks.join(now, key)
    return joined.filter((F.size("_now") > 0) & (F.col("_now") != F.array_sort(F.array_distinct(evidence)))).select(key)


def split_stale(stale: DataFrame, removed: DataFrame, key: str = "chunk_id", evidence: str = "evidence_slugs") -> DataFrame:
    """key, action: 'drop' if all evidence is gone, else 'regenerate'."""
    items = stale.select(key, F.explode_outer(evidence).alias("slug"))
    gone = removed.select("slug").distinct().withColumn("_gone", F.lit(1))
    per = items.join(gone, "slug", "left").groupBy(key).agg(F.count("slug").alias("n"), F.count("_gone").alias("g"))
    return per.select(key, F.when((F.col("n") > 0) & (F.col("n") == F.col("g")), "drop").otherwise("regenerate").alias("action"))


def carry_over(chunks: DataFrame, stale: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks that are reused as they are."""
    return chunks.join(stale.select(key), key, "left_anti")


def last_vectors(vectors: DataFrame) -> DataFrame:
    """One vector a slug: the last."""
    return vectors.groupBy("slug").agg(F.max_by("embedding", "row_ord").alias("embedding"))


def stack_vectors(order: DataFrame, fresh: DataFrame, prior: DataFrame) -> DataFrame:
    """slug, ord, embedding, source in the order wanted: fresh before prior, absent ones dropped."""
    f, p = fresh.select("slug", F.col("embedding").alias("_f")), prior.select("slug", F.col("embedding").alias("_p"))
    rows = order.join(f, "slug", "left").join(p, "slug", "left")
    return rows.select("slug", "ord", F.coalesce("_f", "_p").alias("embedding"), F.when(F.col("_f").isNotNull(), "fresh").otherwise("prior").alias("source")).filter(F.col("embedding").isNotNull())


def keep_aligned(chunks: DataFrame, vectors: DataFrame, key: str = "slug") -> DataFrame:
    return chunks.join(vectors.select(key).distinct(), key, "left_semi")


def archetype_union(prior: DataFrame, new: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """Prior rows first, then new ones with unseen ids; the first of equal ids stays."""
    both = prior.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)))
    w = Window.partitionBy(key).orderBy("_src", order)
    return both.withColumn("_nr", F.row_number().over(w)).filter("_nr = 1").drop("_nr", "_src")


def slug_sets(prior: DataFrame, new: DataFrame) -> DataFrame:
    """slug, part: 'only_prior', 'only_new' or 'both'."""
    p, n = prior.select("slug").distinct(), new.select("slug").distinct()
    tag = lambda df, name: df.withColumn("part", F.lit(name))
    return tag(p.join(n, "slug", "left_anti"), "only_prior").unionByName(tag(n.join(p, "slug", "left_anti"), "only_new")).unionByName(tag(p.join(n, "slug", "left_semi"), "both"))


def report(diff: DataFrame, stale: DataFrame, embedded: DataFrame | None = None, carried: DataFrame | None = None, new: DataFrame | None = None, thesis_reused: bool = True) -> DataFrame:
    """One row of counters. stale: key, action; embedded, carried and new: one row for each page or chunk, None: none."""
    d = diff.agg(*[F.count_if(F.col("status") == s).alias(f"pages_{s}") for s in ("added", "changed", "unchanged", "removed")])
    s = stale.agg(F.count("*").alias("chunks_stale"), F.count_if(F.col("action") == "drop").alias("chunks_dropped"), F.count_if(F.col("action") == "regenerate").alias("chunks_regenerated"))
    out = d.join(s)  # one row each
    for name, rows in (("pages_embedded", embedded), ("chunks_carried", carried), ("chunks_new", new)):
        out = out.withColumn(name, F.lit(0).cast("long")) if rows is None else out.join(rows.agg(F.count("*").alias(name)))
    fraction = changed_fraction(diff).select(F.round("fraction", 4).alias("changed_fraction"))
    return out.join(fraction).withColumn("thesis_reused", F.lit(thesis_reused))


@dataclass(frozen=True)
class Decision:
    mode: str
    reason: str


def decide(prior_model: str | None, model: str, fraction: float) -> Decision:
    """Whether an update may be incremental."""
    if prior_model is None:
        return Decision("full", "no prior state")
    if prior_model != model:
        return Decision("full", "embedding model changed")
    if fraction > REBUILD_ABOVE:
        return Decision("full", f"{fraction:.0%} of pages changed")
    return Decision("incremental", f"{fraction:.0%} of pages changed")


def build_state(pages: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """The tables that the next run compares with."""
    from loomwork.operators.pages import nonblank

    return {
        "pages": nonblank(pages).select("slug", F.sha2("content_full", 256).alias("hash")),
        "chunks": chunks.select("archetype_id", F.sha2("content_full", 256).alias("hash"), "evidence_slugs", "source_query", "quality_score"),
    }


#: The form of a state that is written today.
STATE_VERSION = 1


@dataclass
class State:
    """What one run leaves for the next to compare with, as it travels in a bundle."""

    model: str = ""
    dims: int = 0
    thesis_hash: str = ""
    pages: dict[str, str] = field(default_factory=dict)
    archetypes: list[dict] = field(default_factory=list)
    chunks: dict[str, dict] = field(default_factory=dict)
    version: int = STATE_VERSION

    def to_json(self) -> str:
        parts = {
            "format_version": self.version, "embedding": {"model": self.model, "dims": self.dims}, "thesis": {"hash": self.thesis_hash}, "pages": self.pages,
            "archetypes": self.archetypes, "chunks": self.chunks, "counts": {"pages": len(self.pages), "chunks": len(self.chunks)},
        }
        return json.dumps(parts, ensure_ascii=False, indent=2)

    @classmethod
    def from_json(cls, text: str | bytes | dict) -> State:
        """What is missing or null has its default."""
        d = text if isinstance(text, dict) else json.loads(text)
        part = lambda key: d.get(key) or {}
        return cls(
            str(part("embedding").get("model") or ""), int(part("embedding").get("dims") or 0), str(part("thesis").get("hash") or ""), dict(part("pages")),
            list(d.get("archetypes") or []), dict(part("chunks")), int(d.get("format_version") or STATE_VERSION),
        )

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """As build_state() makes them, with the archetypes."""
        chunks = [(k, c.get("hash"), list(c.get("evidence_slugs") or []), c.get("source_query") or "", float(c.get("quality_score") or 0.0)) for k, c in self.chunks.items()]
        return {
            "pages": spark.createDataFrame(list(self.pages.items()), "slug string, hash string"),
            "chunks": spark.createDataFrame(chunks, "archetype_id string, hash string, evidence_slugs array<string>, source_query string, quality_score double"),
            "archetypes": spark.createDataFrame([(a.get("id"), a.get("category"), a.get("query"), i) for i, a in enumerate(self.archetypes)], "id string, category string, query string, ord long"),
        }


def state_of(tables: dict[str, DataFrame], archetypes: DataFrame, model: str, dims: int, thesis_hash: str) -> State:
    """The state of a corpus that one machine holds, as a bundle does; larger ones keep the tables."""
    rows = {k: [r.asDict(recursive=True) for r in df.collect()] for k, df in tables.items()}
    asked = [r.asDict() for r in archetypes.orderBy("ord").select("id", "category", "query").collect()]
    return State(model, dims, thesis_hash, {r["slug"]: r["hash"] for r in rows["pages"]}, asked, {r.pop("archetype_id"): r for r in rows["chunks"]})
