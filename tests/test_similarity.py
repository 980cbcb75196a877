"""The similarity join over several blocks and strips against a plain sort."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from voxlake.operators import similarity


@pytest.mark.parametrize("metric", similarity.METRICS)
@pytest.mark.parametrize("k", [1, 5, 40])
def test_top_of_blocks(spark, monkeypatch, metric, k):
    monkeypatch.setattr(similarity, "MIN_BLOCK", 1)
    rng = np.random.default_rng(k)
    q, x = rng.normal(size=(30, 4)), rng.normal(size=(150, 4))
    x[rng.integers(0, 150, 60)] = x[0]  # copies tie
    rows = lambda v, name: spark.createDataFrame([("p", i, r.tolist()) for i, r in enumerate(v)], f"pair_id string, {name} long, feat array<double>")
    found = similarity.top_k(rows(q, "query_id"), rows(x, "key_id"), k, metric, 10, 60)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[1].split("SortMergeJoin")[0]
    a, b = (v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-8) if metric == "cosine" else v for v in (q, x))
    score = np.round(-((a[:, None] - b[None]) ** 2).sum(2) if metric == "neg_sq_l2" else a @ b.T, 9)
    want = {(i, int(j)): (rank + 1, score[i, j]) for i in range(30) for rank, j in enumerate(np.lexsort((np.arange(150), -score[i]))[:k])}
    got = {(r["query_id"], r["key_id"]): (r["rank"], r["score"]) for r in found.collect()}
    assert got.keys() == want.keys() and all(got[p][0] == want[p][0] and abs(got[p][1] - want[p][1]) < 1e-8 for p in want)


def test_strips(monkeypatch):
    """Runs of keys, rounding across the bound, rows that tie throughout, and scores that aren't numbers."""
    scores = np.random.default_rng(0).normal(size=(20, 1000)).round(2)
    scores[3] = 0.5
    scores[4, ::3] += 1e-12 * np.arange(334)
    for k in (1, 3, 7):
        want = np.stack([np.lexsort((np.arange(1000), -r))[:k] for r in np.round(scores, 9)])
        row, column, found = similarity._strip_best(scores, k)
        assert (column.reshape(20, k) == want).all() and (row == np.repeat(np.arange(20), k)).all()
        assert (found == np.round(scores, 9)[row, column] + 0.0).all()
    scores[5, 2] = np.nan
    row, column, _ = similarity._strip_best(scores, 2)
    assert len(row) == 40 and (column.reshape(20, 2)[6] == np.lexsort((np.arange(1000), -scores[6]))[:2]).all()


def test_volumes_of_predictions_ask_once(spark, sf):
    from voxlake.catalog import matching

    found = matching.C.queries["P38_prediction_volumes"](spark, sf)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_blocks_are_written_once(spark, monkeypatch):
    """However many blocks a pair has, a shuffle holds each of its rows once; of 36 query blocks and 25 key blocks here."""
    monkeypatch.setattr(similarity, "MIN_BLOCK", 1)
    monkeypatch.setattr(similarity, "FEW_PAIRS", 1)
    rng = np.random.default_rng(0)
    vectors = {p: (rng.normal(size=(n, 4)), rng.normal(size=(m, 4))) for p, n, m in (("a", 120, 200), ("b", 60, 50), ("only queries", 5, 0), ("only keys", 0, 5))}
    rows = lambda side, name: spark.createDataFrame([(p, i, r.tolist()) for p, v in vectors.items() for i, r in enumerate(v[side])], f"pair_id string, {name} long, feat array<double>")
    found = similarity.top_k(rows(0, "query_id"), rows(1, "key_id"), 3, "dot", 5, 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan
    want = {(p, i, int(j)) for p in "ab" for i, s in enumerate(np.round(vectors[p][0] @ vectors[p][1].T, 9)) for j in np.lexsort((np.arange(len(s)), -s))[:3]}
    assert {(r["pair_id"], r["query_id"], r["key_id"]) for r in found.collect()} == want


def test_best_of_a_part():
    """Blocks of keys that come one after the other leave k rows for each query, ties to the smaller key."""
    rng = np.random.default_rng(1)
    q, x = rng.integers(-2, 3, (7, 3)).astype(float), rng.integers(-2, 3, (40, 3)).astype(float)
    ids = rng.permutation(40)
    cells = [("p", 0, list(range(7)), q.tolist(), ids[at : at + 8].tolist(), x[at : at + 8].tolist()) for at in range(0, 40, 8)]
    columns = ["pair_id", "_q", "q_ids", "q_feats", "k_ids", "k_feats"]
    batches = [pa.RecordBatch.from_pydict({c: [r[k]] for k, c in enumerate(columns)}) for r in cells]
    found = [tuple(r.values()) for batch in similarity._best(2, "dot")(iter(batches)) for r in batch.to_pylist()]
    scores = q @ x.T
    assert found == [("p", i, int(ids[j]), scores[i, j]) for i in range(7) for j in np.lexsort((ids, -scores[i]))[:2]]
