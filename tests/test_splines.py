"""Zoom by cubic splines against the solution of the spline's linear system."""

from __future__ import annotations

import numpy as np
import pytest

from voxlake.operators import grids, splines


def line_matrix(n, new):
    """new x n: four taps of the coefficients that make the mirrored spline pass through n values."""
    mirror = lambda i: 0 if n == 1 else min(abs(i) % (2 * n - 2), 2 * n - 2 - abs(i) % (2 * n - 2))
    through, taps = np.zeros((n, n)), np.zeros((new, n))
    for i in range(n):
        for k, w in ((-1, 1 / 6), (0, 4 / 6), (1, 1 / 6)):
            through[i, mirror(i + k)] += w
    for j in range(new):
        x = j * (n - 1) / (new - 1) if new > 1 else 0.0
        for i in range(int(x) - 1, int(x) + 3):
            r = abs(x - i)
            taps[j, mirror(i)] += (2 / 3 - r**2 + r**3 / 2) if r < 1 else max(2 - r, 0) ** 3 / 6
    return taps @ np.linalg.inv(through)


@pytest.mark.parametrize(("n", "new"), [(1, 1), (1, 4), (2, 2), (2, 7), (3, 5), (10, 4), (10, 10), (9, 1), (40, 77)])
def test_lines(n, new):
    x = np.random.default_rng(n).normal(size=(n, 3))
    assert np.allclose(splines.zoom_line(x, new), line_matrix(n, new) @ x, atol=1e-9)
    if new == n:
        assert np.allclose(splines.zoom_line(x, new), x)


@pytest.mark.parametrize("factors", [(1.5, 0.6, 2.0), (1.0, 1.0, 1.0), (0.1, 3.0, 1.0)])
def test_volumes(spark, factors):
    volumes = {"a": np.random.default_rng(1).normal(size=(5, 6, 4)), "b": np.random.default_rng(2).normal(size=(1, 3, 2))}
    rows = spark.createDataFrame([(v, *map(int, at), float(x[at])) for v, x in volumes.items() for at in np.ndindex(x.shape)], "vid string, d int, h int, w int, value double")
    found = grids.zoomed(rows, factors, order=3).collect()
    for v, x in volumes.items():
        want = x
        for axis, f in enumerate(factors):
            m = line_matrix(x.shape[axis], max(round(x.shape[axis] * f), 1))
            want = np.moveaxis(np.tensordot(m, want, (1, axis)), 0, axis)
        own = {(r["d"], r["h"], r["w"]): r["value"] for r in found if r["vid"] == v}
        assert len(own) == want.size and all(np.isclose(own[at], want[at]) for at in np.ndindex(want.shape))


def test_planes_must_be_whole(spark):
    rows = spark.createDataFrame([("a", 0, 0, 0, 1.0), ("a", 0, 1, 1, 1.0)], "vid string, d int, h int, w int, value double")
    with pytest.raises(Exception, match="isn't whole"):
        grids.zoomed(rows, (2, 2, 2), order=3).collect()
    with pytest.raises(ValueError, match="0, 1 or 3"):
        grids.zoomed(rows, (2, 2, 2), order=2)
    assert grids.zoomed(rows.limit(0), (2, 2, 2), order=3).collect() == []


def test_partial_zoom_of_whole_volumes_is_the_zoom(spark):
    x = np.random.default_rng(3).normal(size=(4, 5, 3))
    rows = spark.createDataFrame([("a", *map(int, at), float(x[at])) for at in np.ndindex(x.shape)], "vid string, d int, h int, w int, value double")
    found = [{(r["d"], r["h"], r["w"]): r["value"] for r in grids.zoomed(rows, (1.5, 0.6, 2.0), order=3, partial=p).collect()} for p in (False, True)]
    assert found[0].keys() == found[1].keys() and all(np.isclose(found[0][k], found[1][k]) for k in found[0])
