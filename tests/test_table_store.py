"""The store on disk: buckets, versions, writers and readers at one time."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomwork.operators.table_store import Conflict, TableStore


def rows(spark, ids, v=1):
    return spark.createDataFrame([(i, v) for i in ids], "id long, v int")


def held(store, tenant="t"):
    return {(r.id, r.v) for r in store.read("c", tenant).collect()}


def data_files(root):
    return {p for p in Path(root).rglob("part-*.parquet")}


def test_a_batch_rewrites_its_buckets_only(spark, tmp_path):
    s = TableStore(spark, str(tmp_path), buckets=32)
    s.upsert("c", "t", rows(spark, range(2000)))
    before = data_files(tmp_path)
    touched = {r.b for r in rows(spark, [3, 4, 5000]).select(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(32)).alias("b")).distinct().collect()}
    s.upsert("c", "t", rows(spark, [3, 4, 5000], 9))
    new = data_files(tmp_path) - before
    assert len(before) == 32 and {int(p.parent.name.split("=")[1]) for p in new} == touched and len(new) == len(touched) <= 3
    assert held(s) == {(i, 9 if i in (3, 4) else 1) for i in range(2000)} | {(5000, 9)}
    # the version before stays, what only the one before that names goes
    s.delete("c", "t", rows(spark, [7]).select("id"))
    s.delete("c", "t", rows(spark, [8]).select("id"))
    assert len(held(s)) == 1999 and len(list(Path(tmp_path).rglob("m-*.json"))) == 2
    assert not (before & data_files(tmp_path)) & {p for p in before if int(p.parent.name.split("=")[1]) in touched}


def test_of_two_writers_one_fails(spark, tmp_path):
    class Late(TableStore):
        """Another writer is done while this one writes."""

        def _write(self, at, rows_, key, n):
            other, self.other = getattr(self, "other", None), None
            if other:
                other()
            return super()._write(at, rows_, key, n)

    one = TableStore(spark, str(tmp_path), buckets=8)
    one.upsert("c", "t", rows(spark, [0]))
    late = Late(spark, str(tmp_path), buckets=8)
    late.other = lambda: one.upsert("c", "t", rows(spark, [1]))
    with pytest.raises(Conflict):
        late.upsert("c", "t", rows(spark, [2]))
    assert held(one) == {(0, 1), (1, 1)}
    # far behind: the number it wants is free again, and it still fails
    late.other = lambda: [one.upsert("c", "t", rows(spark, [k])) for k in (3, 4, 5, 6)]
    with pytest.raises(Conflict):
        late.upsert("c", "t", rows(spark, [2]))
    assert held(one) == {(k, 1) for k in (0, 1, 3, 4, 5, 6)}
    late.retries, late.other = 1, lambda: one.upsert("c", "t", rows(spark, [7]))
    late.upsert("c", "t", rows(spark, [2]))
    assert held(one) == {(k, 1) for k in range(8)}
    named = {f"{p.parent.parent.name}/{p.parent.name}" for p in data_files(tmp_path)}
    at = one._dir("c", "t")
    assert named == {part for n in one._numbers(at) for part in one._load(at, n)["parts"].values()}


def test_readers_keep_their_version(spark, tmp_path):
    s = TableStore(spark, str(tmp_path), buckets=4)
    s.upsert("c", "t", rows(spark, range(100)))
    under_way = s.read("c", "t")
    s.sync("c", "t", rows(spark, range(50, 150), 2), rows(spark, range(10)).select("id"))
    assert under_way.count() == 100 and under_way.agg(F.sum("v")).first()[0] == 100
    assert held(s) == {(i, 1) for i in range(10, 50)} | {(i, 2) for i in range(50, 150)}
    # a batch may be read from the version that it replaces
    s.sync("c", "t", s.read("c", "t").withColumn("v", F.lit(3)), reset=True)
    s.sync("c", "t", s.read("c", "t").filter("id < 20").withColumn("v", F.lit(4)))
    assert held(s) == {(i, 4 if i < 20 else 3) for i in range(10, 150)}


def test_columns_that_come_and_change(spark, tmp_path):
    s = TableStore(spark, str(tmp_path), buckets=8)
    s.upsert("c", "t", rows(spark, range(30)))
    s.upsert("c", "t", spark.createDataFrame([(3, "x")], "id long, note string"))
    assert {(r.id, r.v, r.note) for r in s.read("c", "t").filter("id < 5").collect()} == {(0, 1, None), (1, 1, None), (2, 1, None), (3, None, "x"), (4, 1, None)}
    s.upsert("c", "t", spark.createDataFrame([(4, 2**40)], "id long, v long"))
    assert dict(s.read("c", "t").dtypes)["v"] == "bigint" and s.read("c", "t").agg(F.sum("v")).first()[0] == 28 + 2**40
    # an id of another number type is the same id; ids without a value are added
    s.upsert("c", "t", spark.createDataFrame([(5, 7), (None, 1), (None, 1)], "id int, v int"))
    assert s.read("c", "t").filter("id = 5").first().v == 7 and s.read("c", "t").filter("id IS NULL").count() == 2


def test_deleting_rebucketing_and_cleaning(spark, tmp_path):
    s = TableStore(spark, str(tmp_path), buckets=4)
    s.delete("c", "t")
    s.upsert("c", "t", rows(spark, range(40)))
    s.rebucket("c", "t", 16)
    assert len(held(s)) == 40 and s._manifest(s._dir("c", "t"))["buckets"] == 16
    s.upsert("c", "t", rows(spark, [1], 5))
    assert (1, 5) in held(s) and len(held(s)) == 40
    rows(spark, [9]).write.parquet(f"{s._dir('c', 't')}/d-left-by-a-failed-writer")
    assert s.vacuum("c", "t") == 0 and s.vacuum("c", "t", 0) == 1 and len(held(s)) == 40
    s.delete("c", "t", rows(spark, range(40)).select("id"))
    assert held(s) == set()
    s.delete("c", "t")
    assert s.read("c", "t") is None
    s.upsert("c", "t", rows(spark, [1]))
    assert held(s) == {(1, 1)}
    with pytest.raises(ValueError):
        s.rebucket("c", "nobody", 3)
