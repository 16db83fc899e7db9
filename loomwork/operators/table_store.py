"""A keyed store on disk, by collection and tenant, in buckets of the key's hash.

A tenant's folder holds data folders d-<id>/<bucket> and numbered manifests. A
manifest is one version: the number of buckets, the schema, and for each bucket
that has rows the folder it lies in. A change computes its rows once, reads and
writes only the buckets that they fall into, and then swaps the manifest: the new
one is number n + 1 of the n that the change was based on, and its file is made
only if there is none of that number yet. So of two writers at one time one
fails with a Conflict and has changed nothing (with ``retries`` it begins again
from what the other one left); a failed job leaves the version before in place.

Readers read the folders of the manifest that they began with. The version before
the newest one stays, and what only older ones name goes with the next change.
Folders of writers that failed belong to no version; ``vacuum`` deletes them.

Defined results: a batch has one row an id; rows without an id are added, never
replaced; columns that a batch brings new are null in older rows, and a column
whose type changes is rewritten in all buckets; deleting a tenant leaves a
manifest without rows; a tenant that is not there is no error.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.runtime import discard, kept

BUCKETS = 64
#: Versions that stay.
KEEP = 2


class Conflict(RuntimeError):
    """Another writer changed the tenant meanwhile; nothing was written."""


@dataclass
class SyncResult:
    enabled: bool
    upserted: int = 0
    deleted: int = 0


def bucket_of(key: str, n: int) -> Column:
    """By the key as text, so that an id is in one bucket whatever number type it comes in."""
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(n)).cast("int")


class TableStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, retries: int = 0):
        self.spark, self.root, self.buckets, self.retries = spark, root.rstrip("/"), buckets, retries
        jvm = spark.sparkContext._jvm
        self._path, conf = jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    # --- files ----------------------------------------------------------------

    def _dir(self, collection: str, tenant: str) -> str:
        if not collection or not tenant or "/" in collection + tenant:
            raise ValueError("collection and tenant must be plain names")
        return f"{self.root}/collection={collection}/tenant={tenant}"

    def _names(self, at: str) -> list[str]:
        p = self._path(at)
        return [s.getPath().getName() for s in self._fs.listStatus(p)] if self._fs.exists(p) else []

    def _numbers(self, at: str) -> list[int]:
        return sorted(int(n[2:-5]) for n in self._names(at) if n.startswith("m-"))

    def _load(self, at: str, number: int) -> dict:
        stream = self._fs.open(self._path(f"{at}/m-{number:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _manifest(self, at: str) -> dict | None:
        """The newest version."""
        for last in (False, False, True):
            numbers = self._numbers(at)
            try:
                return self._load(at, numbers[-1]) if numbers else None
            except Py4JJavaError:
                if last:
                    raise  # else it went while newer ones came

    def _swap(self, at: str, manifest: dict) -> None:
        """Make the manifest the newest one, unless its number is taken or passed."""
        own, wanted = self._path(f"{at}/t-{uuid.uuid4().hex}"), self._path(f"{at}/m-{manifest['number']:012d}.json")
        out = self._fs.create(own, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        gateway = self.spark.sparkContext._gateway
        try:
            self._files.rename(own, wanted, gateway.new_array(gateway.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            self._fs.delete(own, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"version {manifest['number']} of {at} is another writer's") from None
            raise
        if self._numbers(at)[-1] > manifest["number"]:  # the number was free because that version has gone again
            self._fs.delete(wanted, False)
            raise Conflict(f"{at} is past version {manifest['number']}")

    def _clean(self, at: str, number: int) -> None:
        """Versions before the last KEEP go, and what only they name."""
        old = [n for n in self._numbers(at) if n <= number - KEEP]
        held = {p for n in range(max(1, number - KEEP + 1), number + 1) for p in self._load(at, n)["parts"].values()}
        folders = {p.split("/")[0] for p in held}
        for n in old:
            for part in set(self._load(at, n)["parts"].values()) - held:
                folder = part.split("/")[0]
                self._fs.delete(self._path(f"{at}/{part if folder in folders else folder}"), True)
            self._fs.delete(self._path(f"{at}/m-{n:012d}.json"), False)

    def vacuum(self, collection: str, tenant: str, older_than_seconds: float = 86_400.0) -> int:
        """Delete data folders that no version names and that are old enough not to be a writer's under way; how many went."""
        at = self._dir(collection, tenant)
        held = {p.split("/")[0] for n in self._numbers(at) for p in self._load(at, n)["parts"].values()}
        now, gone = self.spark.sparkContext._jvm.java.lang.System.currentTimeMillis(), 0
        for s in self._fs.listStatus(self._path(at)) if self._fs.exists(self._path(at)) else []:
            name = s.getPath().getName()
            if name.startswith(("d-", "t-")) and name not in held and now - s.getModificationTime() >= 1000 * older_than_seconds:
                self._fs.delete(s.getPath(), True)
                gone += 1
        return gone

    # --- reading ----------------------------------------------------------------

    def _rows(self, at: str, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        parts = [f"{at}/{p}" for b, p in manifest["parts"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def read(self, collection: str, tenant: str) -> DataFrame | None:
        at = self._dir(collection, tenant)
        manifest = self._manifest(at)
        return None if manifest is None or manifest["schema"] is None else self._rows(at, manifest)

    # --- changing -----------------------------------------------------------------

    def _write(self, at: str, rows: DataFrame, key: str, n: int) -> dict[str, str]:
        """Bucket and folder of the rows, written."""
        name = "bucket"
        while name in rows.columns:
            name = f"_{name}"
        folder = f"d-{uuid.uuid4().hex}"
        # large buckets may be split and small ones put together while they are dealt
        rows.withColumn(name, bucket_of(key, n)).hint("rebalance", name).write.partitionBy(name).parquet(f"{at}/{folder}")
        return {x.split("=")[1]: f"{folder}/{x}" for x in self._names(f"{at}/{folder}") if x.startswith(f"{name}=")}

    def _change(self, collection: str, tenant: str, step: Callable[[str, dict | None], dict]) -> None:
        at = self._dir(collection, tenant)
        for left in range(self.retries, -1, -1):
            base = self._manifest(at)
            new = step(at, base) | {"number": base["number"] + 1 if base else 1}
            try:
                self._swap(at, new)
            except Conflict:
                for folder in {p.split("/")[0] for p in new["parts"].values()} - {p.split("/")[0] for p in (base or {"parts": {}})["parts"].values()}:
                    self._fs.delete(self._path(f"{at}/{folder}"), True)
                if not left:
                    raise
                continue
            self._clean(at, new["number"])
            return

    def _whole(self, rows: DataFrame, key: str, n: int) -> Callable[[str, dict | None], dict]:
        return lambda at, _: {"key": key, "buckets": n, "schema": json.loads(rows.schema.json()), "parts": self._write(at, rows, key, n)}

    def replace(self, collection: str, tenant: str, rows: DataFrame, key: str = "id") -> None:
        """All rows."""
        self._change(collection, tenant, self._whole(rows, key, self.buckets))

    def rebucket(self, collection: str, tenant: str, buckets: int) -> None:
        """The same rows in another number of buckets; for a tenant that has grown."""

        def step(at: str, base: dict | None) -> dict:
            if base is None or base["schema"] is None:
                raise ValueError("there is no such tenant")
            return self._whole(self._rows(at, base), base["key"], buckets)(at, base)

        self._change(collection, tenant, step)

    def _apply(self, collection: str, tenant: str, batch: DataFrame | None, gone: DataFrame | None, key: str) -> None:
        """Upsert, then delete, in one version. batch and gone are tables of kept(), read as often as it takes."""

        def step(at: str, base: dict | None) -> dict:
            if base is None or base["schema"] is None:
                if batch is None:
                    raise ValueError("there is no such tenant")
                rows = batch if gone is None else batch.join(gone, key, "left_anti")
                return self._whole(rows, key, self.buckets)(at, base)
            n, have = base["buckets"], T.StructType.fromJson(base["schema"])
            ids = [x.select(key) for x in (batch, gone) if x is not None]
            every = ids[0] if len(ids) == 1 else ids[0].unionByName(ids[1])
            touched = {r.b for r in every.select(bucket_of(key, n).alias("b")).distinct().collect()}  # n at most
            schema = have if batch is None else self.spark.createDataFrame([], have).unionByName(batch.limit(0), allowMissingColumns=True).schema
            kinds = {f.name: f.dataType for f in schema}
            if any(kinds[f.name] != f.dataType for f in have):
                touched = set(range(n))
            rows = self._rows(at, base, sorted(touched)).join(every, key, "left_anti")
            if batch is not None:
                rows = rows.unionByName(batch if gone is None else batch.join(gone, key, "left_anti"), allowMissingColumns=True)
            parts = {b: p for b, p in base["parts"].items() if int(b) not in touched}
            return {"key": key, "buckets": n, "schema": json.loads(schema.json()), "parts": parts | self._write(at, rows, key, n)}

        self._change(collection, tenant, step)

    def upsert(self, collection: str, tenant: str, batch: DataFrame, key: str = "id") -> None:
        self.sync(collection, self._dir(collection, tenant) and tenant, batch, key=key)

    def delete(self, collection: str, tenant: str, ids: DataFrame | None = None, key: str = "id") -> None:
        """Some ids, or with None the whole tenant; a tenant that is not there is no error."""
        if self.read(collection, tenant) is None:
            return
        if ids is None:
            self._change(collection, tenant, lambda at, base: {"key": key, "buckets": self.buckets, "schema": None, "parts": {}})
            return
        once = kept(ids.select(key), "gone")
        try:
            self._apply(collection, tenant, None, once, key)
        finally:
            discard(once)

    def sync(self, collection: str, tenant: str | None, batch: DataFrame, gone: DataFrame | None = None, reset: bool = False, key: str = "id") -> SyncResult:
        """Without a tenant nothing is stored. Batches are computed once, whatever they are read from."""
        if not tenant:
            return SyncResult(False)
        once, out = kept(batch, "batch"), None if gone is None else kept(gone.select(key), "gone")
        try:
            done = SyncResult(True, once.count(), 0 if out is None else out.count())
            if reset:
                self.replace(collection, tenant, once, key)
            else:
                self._apply(collection, tenant, once, out, key)
            return done
        finally:
            discard(once, out)
