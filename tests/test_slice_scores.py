"""Scores of slice search by blocks of rows against plain loops."""

from __future__ import annotations

import re

import numpy as np
import pytest

from voxlake.operators import slice_search


def test_scores_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(slice_search, "SCORE_ROWS", 3)
    x = np.random.default_rng(0).normal(size=(11, 9))
    there = np.random.default_rng(1).random(x.shape) > 0.2
    there[10, 8] = True
    rows = [("p", *map(int, at), float(x[at]) if there[at] else None) for at in np.ndindex(x.shape) if there[at] or at[0] % 2]
    matrix = spark.createDataFrame(rows, "pair_id string, i int, j int, value double")
    shifts = spark.createDataFrame([("p", t, t - 6) for t in range(13)], "pair_id string, t int, shift int")
    found = slice_search.scores(matrix, [0.9, 1.0, 1.1], shifts)
    assert "Broadcast" not in found._jdf.queryExecution().optimizedPlan().toString() and "Join Cross" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for s, scale in enumerate((0.9, 1.0, 1.1)):
        for t in range(13):
            met = [x[i, j] for i in range(11) if 0 <= (j := int(np.rint(scale * i + t - 6))) < 9 and there[i, j]]
            want[s, t, t - 6] = np.mean(met) if len(met) >= 4.5 else None
    got = {(r["s"], r["t"], r["shift"]): r["score"] for r in found.collect()}
    assert got.keys() == want.keys() and all((got[k] is None) == (want[k] is None) and (got[k] is None or got[k] == pytest.approx(want[k])) for k in want)


def test_matrices_by_blocks(spark, monkeypatch):
    """Products of blocks of 4 slices, some voxels lacking, and weights, against whole matrices."""
    monkeypatch.setattr(slice_search, "PRODUCT_SLICES", 4)
    rng = np.random.default_rng(3)
    volumes = [rng.normal(size=(n, 2, 3, 2)) for n in (11, 9)]
    for x in volumes:
        x[rng.random(x.shape[:3]) < 0.2] = 0
    volumes[0][5] = 0
    rows = [spark.createDataFrame([("p", d, h, w, x[d, h, w].tolist()) for d, h, w in np.ndindex(x.shape[:3]) if x[d, h, w].any()], "pair_id string, d int, h int, w int, feat array<double>") for x in volumes]
    indexes = [spark.range(len(x)).selectExpr("'p' AS pair_id", "cast(id AS int) AS idx") for x in volumes]
    matrix = slice_search.cosine_matrix(*(slice_search.slice_vectors(v, "x") for v in rows), *indexes)
    x, y = (v.reshape(len(v), -1) / (np.linalg.norm(v.reshape(len(v), -1), axis=1)[:, None] + 1e-10) for v in volumes)
    dense = lambda df: np.array([r["value"] for r in df.orderBy("i", "j").collect()]).reshape(11, 9)
    assert np.allclose(dense(matrix), x @ y.T)
    unit = lambda m: (m - m.min()) / (m.max() - m.min())
    want = unit(x @ y.T)
    r, c = want / want.sum(1, keepdims=True), want / want.sum(0)
    weighted = slice_search.reweighted(matrix)
    assert np.allclose(dense(weighted), unit((r * c.sum() + c * r.sum()) / (r.sum() + c.sum())))


def test_no_matrix_is_shuffled_by_its_pair_alone(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        matrix = spark.range(60).selectExpr("cast(id % 7 AS string) AS pair_id", "cast(id div 10 AS int) AS i", "cast(id % 10 AS int) AS j", "rand(1) AS value")
        plan = slice_search.reweighted(matrix)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.split("\n")
    alone = [k for k, x in enumerate(lines) if re.search(r"hashpartitioning\(pair_id#\d+, \d+\)", x)]
    # what is dealt by pair alone are sums of rows or columns
    assert alone and all("HashAggregate" in lines[k + 1] for k in alone)
