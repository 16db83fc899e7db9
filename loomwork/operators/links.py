"""The link graph of pages: edges, neighbours, and questions about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions.text import crossrefs
from loomwork.runtime import pin

MOST_HOPS = 5


def newest_pages(pages: DataFrame) -> DataFrame:
    """One row for each slug: the last in page order."""
    best = pages.groupBy("slug").agg(F.max_by(F.struct(*[c for c in pages.columns if c != "slug"]), "page_ord").alias("p"))
    return best.select("slug", "p.*")


def edges(pages: DataFrame, frontmatter: bool = True) -> DataFrame:
    """src, dst: distinct links between pages that exist, self-links left out."""
    fm = F.col("frontmatter") if frontmatter and "frontmatter" in pages.columns else None
    out = pages.select(F.col("slug").alias("src"), F.explode(crossrefs(F.col("body"), fm)).alias("dst"))
    known = pages.select(F.col("slug").alias("dst")).distinct()
    return out.filter("src <> dst").join(known, "dst", "left_semi").select("src", "dst").distinct()


def backlinks(e: DataFrame, slug: str) -> DataFrame:
    return e.filter(F.col("dst") == slug).select(F.col("src").alias("slug"))


def forward_links(e: DataFrame, slug: str) -> DataFrame:
    return e.filter(F.col("src") == slug).select(F.col("dst").alias("slug"))


def neighborhood(e: DataFrame, slug: str, depth: int = 2) -> DataFrame:
    """level, slug: pages by their distance from ``slug``, links taken either way; the start is left out."""
    spark = e.sparkSession
    # every level reads the links again
    e = pin(e.select("src", "dst"))
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seen = spark.createDataFrame([(0, slug)], "level int, slug string")
    front = seen
    for level in range(1, max(1, min(depth, MOST_HOPS)) + 1):
        reached = both.join(front.select(F.col("slug").alias("src")), "src").select(F.col("dst").alias("slug")).distinct()
        front = reached.join(seen, "slug", "left_anti").select(F.lit(level).alias("level"), "slug")
        front = pin(front)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.filter("level > 0")


def orphans(pages: DataFrame, e: DataFrame) -> DataFrame:
    """Pages that no page links to."""
    return pages.select("slug").join(e.select(F.col("dst").alias("slug")), "slug", "left_anti")


def most_cited(e: DataFrame, n: int) -> DataFrame:
    return e.groupBy(F.col("dst").alias("slug")).agg(F.count("*").alias("n_links")).orderBy(F.desc("n_links"), "slug").limit(n)
