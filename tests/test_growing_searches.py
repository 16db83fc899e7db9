"""Searches whose queries grow with the table, against brute force."""

import numpy as np
import pytest

from loomwork import catalog


def test_every_50th_vector_is_searched(spark, tmp_path):
    v = np.random.default_rng(3).normal(size=(300, 64)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = np.arange(1000, 1300)
    rows = [(int(i), [float(x) for x in e], 0) for i, e in zip(ids, v)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    score = v.astype(np.float64) @ v.astype(np.float64).T
    ask = [k for k in range(300) if ids[k] % 50 == 0]
    got = {(r.query_id, r.rank): (r.id, r.score) for r in catalog.queries()["vec_topk_batch"](spark, str(tmp_path)).collect()}
    want = {}
    for k in ask:
        best = [o for o in np.argsort(-score[k]) if o != k][:3]
        want |= {(int(ids[k]), n): (int(ids[o]), pytest.approx(score[k, o], abs=1e-4)) for n, o in enumerate(best, 1)}
    assert got == want and len(got) == 18
    # every query vector is itself among the new rows, so each of its answers drifts
    drift = catalog.queries()["stale_drift"](spark, str(tmp_path)).collect()
    assert {r.chunk_id for r in drift} == {int(ids[k]) for k in ask}
