"""Session helpers shared by the whole library."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ship_code(*modules: str) -> None:
    """Let Python workers run our functions even where they cannot import them.

    Workers find the package by PYTHONPATH. Where the repository is only on the
    driver's ``sys.path``, functions travel by value instead.
    """
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if os.path.realpath(ROOT) in paths:
        return
    for name in modules:
        if name in sys.modules and name not in cloudpickle.list_registry_pickle_by_value():
            cloudpickle.register_pickle_by_value(sys.modules[name])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset on a single machine (as in tests) a temporary one is
    made; a cluster without it is an error.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if base is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomwork-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(base)
    return base


def pin(df):
    """Compute once and cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df, name: str):
    """Written once to the shared folder, and read from there; ``discard`` deletes it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


def discard(*tables) -> None:
    """Delete tables of kept() that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "kept_path", None):
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
