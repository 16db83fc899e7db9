"""What the operators share: scratch tables, small numeric helpers, word rules."""

from __future__ import annotations

import contextlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomwork.runtime import shared_dir

#: A word is a run of anything but space and the controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Drops a query's shuffle files when it ends, not when the driver next collects garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _tidy(spark: SparkSession):
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint.

    The copy lies in the shared folder, so a lost executor costs nothing.
    """
    shared_dir(df.sparkSession)
    with _tidy(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """As settle(), as a compressed Parquet table that drop_stored() can delete; for wide or many rows."""
    path = scratch(df.sparkSession, name)
    with _tidy(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    # with its schema given, no job reads footers
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def stored_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """stored() and the number of rows, from the same job."""
    seen = Observation()
    out = stored(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, int(seen.get["n"])


def drop_stored(*tables: DataFrame | None) -> None:
    """Delete tables of stored() that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "scratch_path", None):
            discard(t.sparkSession, path)


def numbered(docs: DataFrame, name: str = "row") -> DataFrame:
    """A copy of ``docs`` whose rows have ids in ``name``, dealt to buckets by them.

    Ids are written once, so any number of scans see the same ones, whatever
    ``docs`` is. Joins by the id move no texts: the copy lies in their buckets.
    """
    spark = docs.sparkSession
    path, n = scratch(spark, "rows"), min(n_partitions(spark), 100_000)
    rows = docs.withColumn(name, F.monotonically_increasing_id()).repartition(n, name)
    view = f"rows_{uuid.uuid4().hex}"
    with _tidy(spark):
        rows.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, name).saveAsTable(view)
    out = spark.table(view)
    spark.sql(f"DROP TABLE {view}")  # an external table: the files stay, and what was resolved keeps reading them
    out.scratch_path = path
    return out


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with as many underscores as it takes not to clash with a column."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_of(col: str | Column) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ends, data) of an Arrow array of texts without nulls: text i is data[ends[i] : ends[i + 1]]."""
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    offsets, raw = text.buffers()[1:]
    ends = np.frombuffer(offsets, kind)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
    return ends, np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
