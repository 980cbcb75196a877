"""Directions of long vectors by products with blocks, against numpy and against the solved matrices."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.catalog.base import tok
from voxlake.catalog.registration import _wpls_rows
from voxlake.operators import projection, wide


@pytest.mark.parametrize(("channels", "wanted", "basis"), [(3, 3, 256), (40, 5, 256), (300, 6, 40), (300, 300, 256)])
def test_largest_directions_of_a_matrix(monkeypatch, channels, wanted, basis):
    """Spectra that fall slowly, repeated and zero values, bases that are cut back."""
    monkeypatch.setattr(wide, "MAX_BASIS", basis)
    rng = np.random.default_rng(channels)
    q = np.linalg.qr(rng.normal(size=(channels, channels)))[0]
    spectrum = 1 / np.arange(1, channels + 1) ** 0.7
    spectrum[channels // 2 :] = 0
    matrix = (q * spectrum) @ q.T
    values, vectors = wide.krylov(lambda b: matrix @ b, channels, wanted)
    assert np.allclose(values, np.sort(spectrum)[::-1][:wanted], atol=1e-8)
    assert np.allclose(matrix @ vectors, vectors * values, atol=1e-7) and np.allclose(vectors.T @ vectors, np.eye(wanted), atol=1e-8)


def test_directions_of_repeated_values():
    matrix = np.diag([3.0] * 4 + [1.0] * 20)
    values, vectors = wide.krylov(lambda b: matrix @ b, 24, 4)
    assert np.allclose(values, 3) and np.allclose(np.abs(vectors[4:]).max(), 0, atol=1e-8)
    assert np.allclose(wide.krylov(lambda b: 0 * b, 24, 4)[0], 0)


def test_components_of_five_thousand_channels(spark):
    """More channels than the driver solves, fewer rows than channels; a component that isn't finite counts as 0."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 6)) * [9, 7, 5, 3, 2, 1] @ rng.normal(size=(6, 5000)) + 0.3 * rng.normal(size=(120, 5000)) + 4
    x[3, 5] = np.nan
    rows = spark.createDataFrame([(r,) for r in x.tolist()], "feat array<double>").repartition(5)
    model = projection.PCA.fit(rows, 4)
    clean = np.nan_to_num(x)
    centred = clean - clean.mean(0)
    _, s, vh = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(model.mean, clean.mean(0))
    assert np.allclose(np.abs((np.array(model.components) * vh[:4]).sum(1)), 1, atol=1e-6)
    assert np.allclose(model.explained, s[:4] ** 2 / (s[:4] ** 2).sum(), atol=1e-6)
    y = np.array([r["y"] for r in rows.limit(3).select("feat", model.transform(F.col("feat")).alias("y")).collect()])
    assert y.shape == (3, 4)
    assert projection.load(model.to_json()) == model


@pytest.mark.parametrize("unit", [False, True])
def test_components_by_either_way(spark, sf, monkeypatch, unit):
    t = tok(spark, sf)
    solved = projection.PCA.fit(t, 5, unit)
    monkeypatch.setattr(projection, "MAX_CHANNELS", 10)
    found = projection.PCA.fit(t, 5, unit)
    assert np.allclose(found.mean, solved.mean) and np.allclose(found.components, solved.components, atol=1e-6) and np.allclose(found.explained, solved.explained, atol=1e-8)
    assert len(projection.PCA.fit(t.limit(2), 5).components) == 2
    with pytest.raises(ValueError, match="no rows"):
        projection.PCA.fit(t.limit(0), 2)


@pytest.mark.parametrize("means", [False, True])
def test_least_squares_by_either_way(spark, sf, monkeypatch, means):
    rows = _wpls_rows(spark, sf)
    sides = ([0.01 * k for k in range(64)], [0.02 * k for k in range(64)]) if means else None
    alpha = projection.ladder("linear", 2)
    solved = projection.WPLS.fit(rows, sides, 64, 3, alpha)
    monkeypatch.setattr(projection, "MAX_CHANNELS", 10)
    monkeypatch.setattr(wide, "CHUNK", 100)
    found = projection.WPLS.fit(rows, sides, 64, 3, alpha)
    assert np.allclose(found.singular, solved.singular, atol=1e-8)
    assert np.allclose(found.fix_weight, solved.fix_weight, atol=1e-6) and np.allclose(found.mov_weight, solved.mov_weight, atol=1e-6)


def test_blocks_are_bounded(monkeypatch):
    monkeypatch.setattr(wide, "MAX_BLOCK_BYTES", 1000)
    with pytest.raises(ValueError, match="one block"):
        wide.krylov(lambda b: b, 100, 5)
