"""Order statistics by narrowing histograms against numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.operators import intensity, selection


@pytest.mark.parametrize("small", [1 << 14, 3])
def test_ranks_of_odd_values(spark, monkeypatch, small):
    """Signs, zeros of both signs, subnormals, infinities, NaN, ties, nulls, neighbours in the last digit, a null group."""
    monkeypatch.setattr(selection, "SMALL", small)
    monkeypatch.setattr(selection, "BINS", 4)
    rng = np.random.default_rng(3)
    near = [1.0]
    for _ in range(40):
        near.append(math.nextafter(near[-1], 2))
    groups = {
        "a": [*(rng.normal(size=60) * 10.0 ** rng.integers(-300, 300, 60)), 0.0, -0.0, 5e-324, -5e-324, math.inf, -math.inf, math.nan, math.nan, None],
        "b": near[::-1],
        None: [7.0] * 30 + [8.0] * 5,
        "d": [None],
    }
    rows = spark.createDataFrame([(g, None if v is None else float(v)) for g, vs in groups.items() for v in vs], "g string, value double")
    want = {(g, k): v for g, vs in groups.items() for k, v in enumerate(sorted((float(v) for v in vs if v is not None), key=lambda v: (math.isnan(v), v)))}
    ranks = spark.createDataFrame([(g, k) for g, k in want] + [("b", 10**6), ("d", 0), ("none", 0)], "g string, k long")
    found = {(r["g"], r["k"]): r["x"] for r in selection.selected(rows, ranks, ["g"]).collect()}
    assert {x: repr(v + 0.0) for x, v in found.items()} == {x: repr(v + 0.0) for x, v in want.items()}


@pytest.mark.parametrize("ranks", [selection.BROADCAST_RANKS, 0])
def test_percentiles_of_ten_million_distinct_values(spark, monkeypatch, ranks):
    monkeypatch.setattr(selection, "BROADCAST_RANKS", ranks)
    n = 10_000_000 if ranks else 200_000
    rows = spark.range(n).select((F.col("id") % 3 > 0).alias("g"), (F.pow((F.col("id") * 7919 % n).cast("double"), 1.7) - 1e6).alias("value"))
    found = {r["g"]: (r["p0"], r["p1"], r["p2"]) for r in selection.percentiles(rows, (0.0, 0.333, 0.97), ["g"]).collect()}
    ids = np.arange(n)
    values = np.power((ids * 7919 % n).astype(float), 1.7) - 1e6
    for g in (False, True):
        assert found[g] == pytest.approx(np.quantile(values[(ids % 3 > 0) == g], (0.0, 0.333, 0.97)), rel=1e-9)


def test_bounds(spark):
    rows = [("a", float(k), k > 3) for k in range(10)] + [("b", float(k), False) for k in range(4)] + [("c", 5.0, None), ("d", None, True)]
    frame = spark.createDataFrame(rows, "vid string, value double, msk boolean")
    bounds = {r["vid"]: (r["low"], r["high"]) for r in intensity.percentile_bounds(frame, 10, 90).collect()}
    assert bounds == {"a": (4.5, 8.5), "b": (0.0, 3.0), "c": (5.0, 5.0), "d": (None, None)}
    assert intensity.percentile_bounds(frame.limit(0), 10, 90).collect() == []
