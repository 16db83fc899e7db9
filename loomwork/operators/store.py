"""A keyed store of vectors and metadata: upsert, delete, sync, audit, purge, trim.

These functions say what the store holds afterwards; table_store keeps it on disk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.runtime import pin

CAPACITY = 6_500
CLEAN_AT = 5_850
CLEAN_SHARE = 0.10
BATCH = 100
#: Size of the sketches of scores: they are off by one in so many ranks at most.
SKETCH = 10_000


def upsert(target: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """The batch's rows replace those with their ids; the batch has one row an id."""
    return target.join(batch.select(key), key, "left_anti").unionByName(batch, allowMissingColumns=True)


def delete(target: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return target.join(ids.select(key), key, "left_anti")


def sync_delta(target: DataFrame, batch: DataFrame, gone: DataFrame, reset: bool = False, key: str = "id") -> DataFrame:
    """A reset clears first; else upsert, then delete."""
    return batch if reset else delete(upsert(target, batch, key), gone, key)


def upsert_candidates(vectors: DataFrame, metadata: DataFrame, wanted: DataFrame, key: str = "slug") -> DataFrame:
    """Rows that have both a vector and metadata and are to be written."""
    return vectors.join(metadata, key).join(wanted.select(key), key, "left_semi")


def increment(target: DataFrame, ids: DataFrame, counter: str = "reuse_count", key: str = "id") -> DataFrame:
    hit = ids.groupBy(key).agg(F.count("*").alias("_n"))
    return target.join(hit, key, "left").withColumn(counter, F.col(counter) + F.coalesce("_n", F.lit(0))).drop("_n").select(*target.columns)


def quality_histogram(df: DataFrame, col: str = "quality_score") -> DataFrame:
    """bucket, n: only buckets that hold something."""
    q = F.col(col)
    bucket = F.when(q.isNull(), "unset").when(q >= 90, "90-100").when(q >= 75, "75-89").when(q >= 50, "50-74").when(q >= 25, "25-49").otherwise("0-24")
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def audit(df: DataFrame, by: str = "namespace", col: str = "quality_score") -> DataFrame:
    """For each namespace: rows, scored rows, near-perfect ones, validated share, upper median of the scores.

    The median's place counts scored rows only; an empty namespace has none. Two
    scans: the first one's sketches, of bounded size, give two scores between which
    each median lies; the second one counts what lies below and each score between
    them, a few in ten thousand, so that the median is exact and no buffer holds a
    namespace's scores.
    """
    near = 2 / SKETCH  # twice what a sketch may be off by
    counts = pin(
        df.groupBy(by).agg(
            F.count("*").alias("total"), F.count(col).alias("scored"), F.count_if(F.col(col) >= 99.5).alias("near_perfect"),
            F.round(F.avg(F.col("validator_passed").cast("double")), 4).alias("validated"), F.percentile_approx(col, [0.5 - near, 0.5 + near], SKETCH).alias("_between"),
        )
    )
    between = counts.filter("scored > 0").select(F.col(by).alias("_by"), F.floor(F.col("scored") / 2).alias("_place"), F.col("_between")[0].alias("_low"), F.col("_between")[1].alias("_high"))
    seen = df.select(by, col).join(between, F.col(by).eqNullSafe(F.col("_by"))).filter(F.col(col) <= F.col("_high"))
    each = seen.groupBy("_by", "_place", F.when(F.col(col) >= F.col("_low"), F.col(col)).alias("_score")).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_by").orderBy(F.col("_score").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    at = each.withColumn("_upto", upto).filter(F.col("_upto") > F.col("_place")).groupBy("_by").agg(F.min(F.struct("_upto", "_score")).alias("_at"))
    median = F.when(F.col("scored") > 0, F.coalesce("_at._score", F.raise_error(F.lit("a sketch was off by more than it may be")).cast("double")))
    return counts.join(at, F.col(by).eqNullSafe(F.col("_by")), "left").withColumn("median", median).drop("_by", "_at", "_between")


def purge_matches(df: DataFrame, min_quality: float | None, validated_only: bool = False) -> DataFrame:
    """Rows that a purge takes: quality at or ABOVE the limit, and validated if asked; nothing without a condition."""
    if min_quality is None and not validated_only:
        return df.filter(F.lit(False))
    hit = F.lit(True)
    if min_quality is not None:
        hit = hit & (F.coalesce(F.col("quality_score"), F.lit(-1.0)) >= min_quality)
    if validated_only:
        hit = hit & F.coalesce(F.col("validator_passed"), F.lit(False))
    return df.filter(hit)


def purge(df: DataFrame, min_quality: float | None, validated_only: bool = False, dry_run: bool = True, key: str = "id") -> DataFrame:
    """A dry run gives the ids that would go; otherwise the rows that stay."""
    hits = purge_matches(df, min_quality, validated_only)
    return hits.select(key) if dry_run else df.join(hits.select(key), key, "left_anti")


def trim(df: DataFrame, clean_at: int = CLEAN_AT, share: float = CLEAN_SHARE, key: str = "id") -> DataFrame:
    """At ``clean_at`` rows or more the worst share goes, by quality + 6 * reuse; below that all rows stay.

    The cut is an exact rank: how many go is known from the count, so the worst
    are a bounded top-k, not a sort of the store.
    """
    n = df.count()
    go = int(n * share) if n >= clean_at else 0
    worth = F.coalesce(F.col("quality_score"), F.lit(0.0)) + 6 * F.coalesce(F.col("reuse_count"), F.lit(0))
    worst = df.select(key, worth.alias("_worth")).orderBy("_worth", key).limit(go).select(key)
    return df.join(worst, key, "left_anti")
