"""Snapshots compared by summaries: what comes out, and what is read for it."""

import random

import pytest
from pyspark.sql import functions as F

from loomwork.operators import snapshots as S


def rows_read(df) -> int:
    """Rows that the scans of a frame gave when it ran."""
    df.collect()
    held, total = [df._jdf.queryExecution().executedPlan()], 0
    while held:
        node = held.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            held.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            held.append(node.plan())
        else:
            if kind == "FileSourceScanExec":
                total += node.metrics().apply("numOutputRows").value()
            children = node.children()
            held += [children.apply(i) for i in range(children.size())]
    return total


def test_one_page_of_many(spark, tmp_path):
    pages = spark.range(100_000).select(F.concat(F.lit("pages/"), "id").alias("slug"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    one = S.write(pages, f"{tmp_path}/a", 8)
    two = S.write(pages.withColumn("hash", F.when(F.col("slug") == "pages/777", "new").otherwise(F.col("hash"))), f"{tmp_path}/b", 8)
    moved = S.changes(one, two)
    assert [tuple(r) for r in moved.collect()] == [("pages/777", "changed")]
    # of 200,000 rows in both, those of two leaves
    assert 0 < rows_read(S.changes(one, two)) < 1500 and rows_read(S.changes(one, one)) == 0
    assert S.differing(one, one) == (8, []) and len(S.differing(one, two)[1]) == 1
    assert one.count() == 100_000 and S.changed_fraction(one, two) == 1e-5


@pytest.mark.parametrize("bits,other", [(0, 0), (4, 4), (8, 4), (4, 12)])
def test_any_two_snapshots(spark, tmp_path, bits, other):
    r = random.Random(bits)
    prior = [(k, r.choice(["x", "y", None])) for k in range(300)] + [(None, "n")]
    fresh = [(k, h if r.random() < 0.9 else "z") for k, h in prior if k is None or r.random() < 0.95] + [(1000 + k, "x") for k in range(9)]
    p, f = (spark.createDataFrame(x, "slug long, hash string") for x in (prior, fresh))
    a, b = S.write(p, f"{tmp_path}/a", bits), S.write(f, f"{tmp_path}/b", other)
    old, new = dict(prior), dict(fresh)
    want = {k: "added" if k not in old else "removed" if k not in new else "unchanged" if old[k] == new[k] else "changed" for k in old.keys() | new.keys()}
    assert sorted(map(tuple, S.diff(a, b).collect()), key=str) == sorted(want.items(), key=str)
    assert sorted(map(tuple, S.changes(a, b).collect()), key=str) == sorted(((k, s) for k, s in want.items() if s != "unchanged"), key=str)


def test_empty_snapshots(spark, tmp_path):
    none = S.write(spark.createDataFrame([], "slug long, hash string"), f"{tmp_path}/a", 4)
    some = S.write(spark.createDataFrame([(1, "x")], "slug long, hash string"), f"{tmp_path}/b", 4)
    assert S.diff(none, none).count() == 0 and none.count() == 0 and S.changed_fraction(none, some) == 1.0
    assert [tuple(r) for r in S.diff(none, some).collect()] == [(1, "added")] and [tuple(r) for r in S.changes(some, none).collect()] == [(1, "removed")]
    with pytest.raises(ValueError):
        S.write(spark.createDataFrame([(1, "x")], "slug long, hash string"), f"{tmp_path}/c", 3)
