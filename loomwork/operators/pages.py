"""Queries over the table of pages: listings, lookups, provenance, samples, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.text import STORED, is_blank, slug_to_uri

PROVENANCE = ("kind", "sources", "cites", "evidence", "teacher", "quality_score", "thesis_hash", "source_query", "generated_at", "archetype_id", "category")


def kind_of(frontmatter: Column) -> Column:
    return F.coalesce(frontmatter["kind"], F.lit("page"))


def list_by_kind(pages: DataFrame, kind: str | None, limit: int) -> DataFrame:
    """The first pages of a kind in page order; 'chunk' is one kind, 'page' is all others."""
    chunk = F.coalesce(F.col("kind"), F.lit("page")) == "chunk"
    rows = pages if kind is None else pages.filter(chunk if kind == "chunk" else ~chunk)
    return rows.orderBy("page_ord").limit(max(1, limit))


def read_page(pages: DataFrame, slug: str) -> DataFrame:
    """The page of that slug, the last one if there are several; no row if none."""
    return pages.filter(F.col("slug") == slug).orderBy(F.desc("page_ord")).limit(1)


def provenance(pages: DataFrame, slug: str) -> DataFrame:
    """One column for each provenance field, null where the page has none."""
    fm = F.col("frontmatter")
    return read_page(pages, slug).select("slug", *[fm[name].alias(name) for name in PROVENANCE])


def nonblank(pages: DataFrame, col: str = "content_full") -> DataFrame:
    return pages.filter(~is_blank(F.col(col)))


def stratified_first(pages: DataFrame, n: int, kind: str = "kind", order: str = "page_ord") -> DataFrame:
    """About n rows, as many of each kind: its first ones; kinds in the order in which they are first seen."""
    rows = pages.withColumn(kind, F.coalesce(F.col(kind), F.lit("default")))
    # One row a kind.
    kinds = rows.groupBy(kind).agg(F.min(order).alias("_first"))
    per = max(1, n // max(1, kinds.count()))
    w = Window.partitionBy(kind).orderBy(order)
    best = rows.withColumn("_nr", F.row_number().over(w)).filter(F.col("_nr") <= per)
    return best.join(F.broadcast(kinds), kind).orderBy("_first", order).limit(n).drop("_nr", "_first")


def lookup(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """Search hits with their pages; hits without a page are skipped."""
    return hits.join(pages, "slug")


def ordered_evidence(wanted: DataFrame, pages: DataFrame, key: str, slugs: str, text: str) -> DataFrame:
    """key, texts: the texts of a row's list of slugs in the list's order, misses skipped."""
    items = wanted.select(key, F.posexplode(slugs).alias("pos", "slug"))
    found = items.join(pages.select("slug", F.col(text).alias("_t")), "slug")
    return found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_t"))), lambda x: x["_t"]).alias("texts"))


def cites_in_corpus(chunks: DataFrame, pages: DataFrame, key: str, cites: str = "cites") -> DataFrame:
    """Citations of pages that exist, repeats and order kept; rows left with none have an empty list."""
    items = chunks.select(key, F.posexplode_outer(cites).alias("pos", "slug"))
    known = pages.select("slug").distinct().withColumn("_known", F.lit(True))
    found = items.join(known, "slug", "left")
    kept = F.filter(F.array_sort(F.collect_list(F.struct("pos", "slug", "_known"))), lambda x: F.coalesce(x["_known"], F.lit(False)))
    return found.groupBy(key).agg(F.transform(kept, lambda x: x["slug"]).alias(cites))


def resources(pages: DataFrame) -> DataFrame:
    """uri, name, description, mime_type of every page, as clients list them."""
    kind = F.coalesce(F.col("kind"), F.lit("page"))
    title = F.when(F.coalesce(F.col("title"), F.lit("")) == "", F.col("slug")).otherwise(F.col("title"))
    return pages.select(
        slug_to_uri(F.col("slug")).alias("uri"), F.concat(F.lit("["), kind, F.lit("] "), F.substring(title, 1, 120)).alias("name"),
        F.substring(F.col("title"), 1, 200).alias("description"), F.lit("text/markdown").alias("mime_type"),
    )


def store_metadata(pages: DataFrame, longest: int = STORED) -> DataFrame:
    """What a vector store keeps beside a vector: chunks their body and citations, pages their full text."""
    chunk = F.col("kind") == "chunk"
    return pages.select(
        "slug", F.coalesce(F.col("kind"), F.lit("page")).alias("kind"), "title",
        F.substring(F.when(chunk, F.col("body")).otherwise(F.col("content_full")), 1, longest).alias("text"), F.sha2("content_full", 256).alias("content_hash"),
        *[F.when(chunk, F.col(c)).alias(c) for c in ("cites", "category", "quality_score") if c in pages.columns],
    )


def counts(pages: DataFrame) -> DataFrame:
    """n_pages (not blank), n_chunks."""
    chunk = F.coalesce(F.col("kind"), F.lit("page")) == "chunk"
    return pages.agg(F.count_if(~chunk & ~is_blank(F.col("content_full"))).alias("n_pages"), F.count_if(chunk).alias("n_chunks"))


def mean_quality(chunks: DataFrame, col: str = "quality_score") -> DataFrame:
    return chunks.agg(F.round(F.coalesce(F.avg(col), F.lit(0.0)), 2).alias("mean_quality"))


def excerpts(pages: DataFrame, n: int, longest: int) -> DataFrame:
    """text: the first n pages in page order, each cut, in one string; bounded by n * longest."""
    rows = pages.orderBy("page_ord").limit(n)
    line = F.concat(F.lit("## "), F.coalesce("title", "slug"), F.lit("\n"), F.substring("body", 1, longest))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_ord", line.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))
