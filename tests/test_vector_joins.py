"""Joins of vectors by bounds between blocks, against all pairs."""

import numpy as np
import pytest

from loomwork.operators import vector_joins as J


def all_pairs(queries, vectors, k, exclude_self, least=-np.inf):
    good = lambda v: v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v)
    out = {}
    for qi, q in queries:
        if qi is None or not good(q):
            continue
        found = []
        for vi, v in vectors:
            if vi is None or not good(v) or len(v) != len(q) or exclude_self and vi == qi:
                continue
            s = float(np.einsum("d,d->", np.array(q, np.float64), np.array(v, np.float64)))
            if s >= least:
                found.append((-s, vi))
        for rank, (s, vi) in enumerate(sorted(found)[:k], 1):
            out[qi, rank] = (vi, pytest.approx(-s, abs=1e-9))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "i long, embedding array<float>").repartition(5)


def grouped_vectors(seed, groups, each, dims, spread):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 1, (groups, dims))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    rows = [(c + r.normal(0, spread, dims)).astype(np.float32) for c in centres for _ in range(each)]
    return [(i, [float(x) for x in v]) for i, v in enumerate(rows)]


@pytest.mark.parametrize("k,exclude_self,scale", [(1, True, 1.0), (4, False, 1.0), (3, True, 30.0)])
def test_join_equals_all_pairs(spark, k, exclude_self, scale):
    rows = [(i, [float(np.float32(x * (scale if i % 7 == 0 else 1.0))) for x in v]) for i, v in grouped_vectors(k, 8, 20, 6, 0.05)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # copies: ties beyond a block
    odd = [(2000, None), (2001, []), (2002, [None] * 6), (2003, [float("nan")] * 6), (2004, [1.0, 2.0]), (2005, [1.0, 2.5]), (2006, [0.0] * 6), (None, rows[0][1])]
    vectors = rows + odd
    queries = rows[::9] + odd
    plan = J.Plan()
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in J.topk_join(table(spark, queries), table(spark, vectors), k, "i", "i", exclude_self=exclude_self, block=16, few=0, plan=plan).collect()}
    want = all_pairs(queries, vectors, k, exclude_self)
    assert got == want and 0 < plan.joined <= plan.pairs
    few = {(r.query_id, r["rank"]): (r.id, r.score) for r in J.topk_join(table(spark, queries), table(spark, vectors), k, "i", "i", exclude_self=exclude_self, few=10**9).collect()}
    assert few == want


def test_groups_leave_most_pairs_unread(spark):
    rows = grouped_vectors(5, 20, 32, 16, 0.01)
    plan = J.Plan()
    got = {r.query_id: (r.id, r.score) for r in J.near_duplicates(table(spark, rows), 0.9, "i", block=32, few=0, plan=plan).collect()}
    want = {q: v for (q, _), v in all_pairs(rows, rows, 1, True, 0.9).items()}
    assert got == want and len(got) == len(rows) and plan.share < 0.3


def test_no_bound_is_under_a_product():
    r = np.random.default_rng(2)
    import pyarrow as pa

    for _ in range(50):
        x, y = r.normal(0, r.choice([0.1, 1, 5]), (20, 5)), r.normal(r.normal(0, 3), r.choice([0.01, 1]), (30, 5))
        pivots = np.concatenate([x[:3], y[:3]])
        d, centre = J._distances(y, pivots), y.mean(0)
        block = pa.table({"centre": pa.array([centre.tolist()]), "radius": [float(np.linalg.norm(y - centre, axis=1).max())], "norm": [float(np.linalg.norm(y, axis=1).max())], "low": pa.array([d.min(0).tolist()]), "high": pa.array([d.max(0).tolist()])})
        assert (J._bounds(x, block, pivots)[:, 0] >= (x @ y.T).max(1)).all()
        assert (J._bounds(x, block, None)[:, 0] >= (x @ y.T).max(1)).all()


def test_search_over_packed_blocks(spark):
    rows = grouped_vectors(9, 10, 30, 6, 0.05) + [(1000 + i, [0.0] * 6) for i in range(3)] + [(2000, [1.0]), (2001, None)]
    rows += [(3000 + i, rows[5][1]) for i in range(30)]
    usable = J.usable(table(spark, rows), "i", "embedding")
    blocks = J.packed_blocks(usable, J.choose_pivots(usable), 16)
    for ask, k in ((rows[5][1], 7), ([-x for x in rows[8][1]], 400), ([1.0], 3), ([0.0] * 6, 4)):
        want = all_pairs([(0, ask)], rows, k, False)
        got = [(r.id, r.score) for r in J.search(blocks, ask, k).collect()]
        assert {(0, n): x for n, x in enumerate(got, 1)} == want
    assert J.search(blocks, [float("nan")] * 6, 3).count() == 0 and J.search(blocks, rows[5][1], 99, least=2.0).count() == 0


def test_joins_of_nothing(spark):
    none = spark.createDataFrame([], "i long, embedding array<float>")
    some = table(spark, [(1, [1.0])])
    assert J.topk_join(none, some, 2, "i", "i").count() == 0 and J.topk_join(some, none, 2, "i", "i").count() == 0
    assert J.topk_join(none, some, 2, "i", "i", few=0).count() == 0
