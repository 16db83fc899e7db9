"""The memory of past runs: search composed of filter, top-k, threshold and exclusion; rows to add."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions.scores import operations_in, risky_join, run_quality, search_text
from loomwork.operators.store import increment
from loomwork.operators.table_store import TableStore
from loomwork.operators.vectors import HashingEmbedder, cosine, topk
from loomwork.runtime import pin

LEAST_QUALITY = 50.0
LEAST_SCORE = 0.85
MATCHES = 2
DUPLICATE_AT = 0.92


def search(memory: DataFrame, q: Sequence[float], k: int = MATCHES, least_quality: float = LEAST_QUALITY, least_score: float = LEAST_SCORE) -> DataFrame:
    """Successful runs of some quality; the 2k most similar; of these the similar enough ones whose join is safe; the first k."""
    good = F.col("success") & (F.col("quality_score") >= least_quality)
    near = topk(memory, q, 2 * k, id_col="id", where=good, metric=cosine)
    return near.filter((F.col("score") >= least_score) & ~risky_join(F.col("code"))).orderBy(F.desc("score"), "id").limit(k)


def nearest_duplicate(store: DataFrame, q: Sequence[float], threshold: float = DUPLICATE_AT, id_col: str = "id") -> DataFrame:
    """The nearest row if it is near enough; the threshold comes after the top-1."""
    return topk(store, q, 1, id_col=id_col, metric=cosine).filter(F.col("score") >= threshold)


def rows_to_save(runs: DataFrame) -> DataFrame:
    """runs: prompt, code, success, execution_time_ms, output_rows, attempts, requested_columns, output_columns, used_rag, validator_passed."""
    score = run_quality(F.col("success"), F.col("execution_time_ms"), F.col("output_rows"), F.col("attempts"), F.col("requested_columns"), F.col("output_columns"), F.col("used_rag"), F.col("validator_passed"))
    return runs.select("*", score.alias("quality_score"), operations_in(F.col("code")).alias("operations"), F.when(F.col("success"), "success").otherwise("failure").alias("namespace"), F.lit(0).cast("long").alias("reuse_count"))


def save(store: TableStore, collection: str, runs: DataFrame, embedder: HashingEmbedder) -> DataFrame:
    """Adds runs to the memory, successes and failures each to their namespace, with ids of their own; returns the rows."""
    rows = rows_to_save(runs).withColumn("id", F.expr("uuid()"))
    # computed once, so that ids are the same wherever the rows go
    rows = pin(embedder.table(rows.withColumn("_text", search_text(F.col("prompt"), F.col("requested_columns"))), "_text").drop("_text"))
    for name in ("success", "failure"):
        store.upsert(collection, name, rows.filter(F.col("namespace") == name))
    return rows


def count_reuse(store: TableStore, collection: str, namespace: str, ids: DataFrame) -> None:
    """One more use for every id, as often as it is listed."""
    have = store.read(collection, namespace)
    if have is not None:
        used = have.join(ids.select("id").distinct(), "id", "left_semi")
        store.upsert(collection, namespace, increment(used, ids))
