"""Keeping a store in step with a stream of page versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomwork.operators.table_store import TableStore


def latest(batch: DataFrame, key: str = "id", order: str = "version") -> DataFrame:
    """One row an id: the newest of the batch."""
    rest = [c for c in batch.columns if c != key]
    return batch.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def sync_stream(changes: DataFrame, store: TableStore, collection: str, tenant: str, checkpoint: str, deleted: str = "deleted", key: str = "id", order: str = "version", once: bool = False) -> StreamingQuery:
    """Upserts and deletes of a stream, batch by batch. A batch that runs twice changes nothing more: writes go by id and version."""

    def apply(batch: DataFrame, _: int) -> None:
        newest = latest(batch, key, order)
        have = store.read(collection, tenant)
        if have is not None:
            old = have.select(key, F.col(order).alias("_v"))
            newest = newest.join(old, key, "left").filter(F.col("_v").isNull() | (F.col(order) >= F.col("_v"))).drop("_v")
        gone = newest.filter(F.coalesce(F.col(deleted), F.lit(False)))
        store.sync(collection, tenant, newest.filter(~F.coalesce(F.col(deleted), F.lit(False))), gone, key=key)

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def window_counts(events: DataFrame, ts: str = "ts", by: str = "event_type", late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Events by type and time window; those later than the watermark are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), by).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
