"""Operators that SQL can't express, against numpy."""

from __future__ import annotations

import functools
import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.catalog.base import tok, vox
from voxlake.catalog.registration import _wpls_rows
from voxlake.operators import descent, distance, grids, neighbourhood, projection, registration, slice_search, warp
from voxlake.plans import axes, extensions, masks


def volume_rows(spark, volume, name="pair_id", key="p"):
    d, h, w = np.indices(volume.shape[:3])
    kind = "array<double>" if volume.ndim == 4 else "double"
    column = "feat" if volume.ndim == 4 else "value"
    values = volume.reshape(-1, volume.shape[3]).tolist() if volume.ndim == 4 else volume.ravel().tolist()
    rows = [*zip([key] * d.size, d.ravel().tolist(), h.ravel().tolist(), w.ravel().tolist(), values, strict=True)]
    return spark.createDataFrame(rows, f"{name} string, d int, h int, w int, {column} {kind}")


def dense(frame, shape, column):
    out = np.full(shape, np.nan)
    for r in frame.collect():
        out[r["d"], r["h"], r["w"]] = r[column]
    return out


def test_pca(spark, sf):
    t = tok(spark, sf)
    model = projection.PCA.fit(t, 5)
    x = np.array([r["feat"] for r in t.orderBy("vox").collect()])
    centred = x - x.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
    top = vectors[:, ::-1][:, :5].T
    assert np.allclose(np.abs((np.array(model.components) * top).sum(1)), 1, atol=1e-6)
    assert np.allclose(model.explained, values[::-1][:5] / values[::-1][:5].sum(), atol=1e-6)
    y = np.array([r["y"] for r in t.select("vox", model.transform(F.col("feat")).alias("y")).orderBy("vox").collect()])
    assert np.allclose(y, centred @ np.array(model.components).T) and np.allclose(y.mean(0), 0, atol=1e-9)


def test_wpls(spark, sf, tmp_path):
    rows = _wpls_rows(spark, sf)
    alpha = projection.ladder("linear", 2)
    model = projection.WPLS.fit(rows, None, 64, 3, alpha)
    cxy, xv, yv, total = np.zeros((64, 64)), np.zeros(64), np.zeros(64), 0.0
    table = rows.toPandas()
    for (_, level), part in table.groupby(["pair_id", "level"]):
        w = part["msk"].to_numpy(float)
        w = w / w.mean()
        x, y = (np.stack(part[c].map(np.asarray)) for c in "xy")
        xc, yc = x - (w[:, None] * x).sum(0) / w.sum(), y - (w[:, None] * y).sum(0) / w.sum()
        cxy += alpha[level] * (xc * w[:, None]).T @ yc
        if level == 1:
            xv, yv, total = xv + (w[:, None] * xc**2).sum(0), yv + (w[:, None] * yc**2).sum(0), total + w.sum()
    u, s, vh = np.linalg.svd(cxy / np.sqrt(xv / total + 1e-3)[:, None] / np.sqrt(yv / total + 1e-3)[None])
    assert np.allclose(model.singular, s[:3])
    assert np.allclose(np.abs((np.array(model.mov_weight) * u[:, :3]).sum(0)), 1) and np.allclose(np.abs((np.array(model.fix_weight) * vh.T[:, :3]).sum(0)), 1)
    projection.save(model, spark, f"{tmp_path}/model")
    assert projection.read(spark, f"{tmp_path}/model") == model
    unknown = spark.createDataFrame([([1.0] * 64, 5)], "feat array<double>, mod_code int")
    assert model.transform(unknown).first()["feat"] == [0.0, 0.0, 0.0]


def test_wpls_of_equal_sides_has_equal_vectors(spark, sf):
    rows = _wpls_rows(spark, sf).where("level = 0").withColumn("x", F.col("y"))
    model = projection.WPLS.fit(rows, None, 64, 3, [1.0])
    assert np.allclose(model.fix_weight, model.mov_weight, atol=1e-6)


def replicated(v, step, axis):
    at = np.clip(np.arange(v.shape[axis]) + step, 0, v.shape[axis] - 1)
    return np.take(v, at, axis)


def box(v, radius):
    for axis in range(3):
        v = sum(replicated(v, s, axis) for s in range(-radius, radius + 1)) / (2 * radius + 1)
    return v


def zero_box(v, radius):
    for axis in range(3):
        wide = np.pad(v, [(radius, radius) if k == axis else (0, 0) for k in range(v.ndim)])
        v = sum(np.take(wide, np.arange(k, k + v.shape[axis]), axis) for k in range(2 * radius + 1)) / (2 * radius + 1)
    return v


@pytest.mark.parametrize(("radius", "dilation"), [(1, 1), (2, 2)])
def test_self_similarity(spark, radius, dilation):
    v = np.random.default_rng(0).normal(size=(6, 5, 7))
    found = neighbourhood.self_similarity(volume_rows(spark, v), radius, dilation, ["pair_id"])
    shifts = [next(replicated(v, o * dilation, k) for k, o in enumerate(off) if o) for off in neighbourhood.SIX]
    pairs = [(i, j) for i in range(6) for j in range(6) if i > j and sum((a - b) ** 2 for a, b in zip(neighbourhood.SIX[i], neighbourhood.SIX[j], strict=True)) == 2]
    ssd = np.stack([box((shifts[i] - shifts[j]) ** 2, radius) for i, j in pairs], -1)
    x = ssd - ssd.min(-1, keepdims=True)
    spread = x.mean(-1, keepdims=True)
    x = np.exp(-x / np.clip(spread, spread.mean() * 0.001, spread.mean() * 1000))[..., list(neighbourhood.CHANNEL_ORDER)]
    for r in found.collect():
        assert np.allclose(r["feat"], x[r["d"], r["h"], r["w"]])
    assert found.count() == v.size


@pytest.mark.parametrize("sigma", [0.7, 1.0])
def test_gaussian(spark, sigma):
    v = np.random.default_rng(1).normal(size=(5, 6, 4))
    radius = int(np.ceil(sigma * 1.5))
    k = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma**2))
    want = v
    for axis in range(3):
        want = sum(w * replicated(want, s, axis) for s, w in zip(range(-radius, radius + 1), k / k.sum(), strict=True))
    assert np.allclose(dense(neighbourhood.smoothed(volume_rows(spark, v), "value", sigma, ["pair_id"]), v.shape, "value"), want)


@pytest.mark.parametrize("sigma", [1.2, 1.3, 1.6, 2.2, 2.8, 4.0, 7.5])
def test_wide_gaussians_are_four_boxes(sigma):
    """The widths are odd, two neighbouring ones at most, and no other such four come nearer to the variance."""
    widths = neighbourhood.box_passes(sigma)
    assert all(w % 2 and w > 1 for w in widths) and len(widths) <= 4 and max(widths) - min(widths) <= 2
    reached = sum(w**2 - 1 for w in widths) / 12
    every = [sum(w**2 - 1 for w in c) / 12 for n in range(1, 31, 2) for c in itertools.combinations_with_replacement((n, n + 2), 4)]
    assert abs(reached - sigma**2) == pytest.approx(min(abs(v - sigma**2) for v in every))


def test_wide_gaussian_of_a_volume(spark):
    v = np.random.default_rng(1).normal(size=(9, 7, 6))
    want = v
    for width in neighbourhood.box_passes(1.6):
        want = zero_box(want, (width - 1) // 2)
    assert np.allclose(dense(neighbourhood.smoothed(volume_rows(spark, v), "value", 1.6, ["pair_id"]), v.shape, "value"), want)


def test_holes_and_dilation(spark):
    v = np.zeros((7, 7, 7))
    v[1:6, 1:6, 1:6] = 1
    v[2:5, 2:5, 2:5] = 0
    frame = volume_rows(spark, v).select("pair_id", "d", "h", "w", (F.col("value") > 0).alias("msk"))
    filled = neighbourhood.holes_filled(frame, 6, ["pair_id"])
    assert dense(filled, v.shape, "msk").sum() == 125
    assert dense(neighbourhood.holes_filled(filled, 26, ["pair_id"]), v.shape, "msk").sum() == 125
    assert dense(neighbourhood.dilated(filled, 3, ["pair_id"]), v.shape, "msk").sum() == 343
    diagonal = v.copy()
    diagonal[1, 1, 1] = 0  # the cavity meets the outside by a corner
    corner = volume_rows(spark, diagonal).select("pair_id", "d", "h", "w", (F.col("value") > 0).alias("msk"))
    sizes = [dense(neighbourhood.holes_filled(corner, c, ["pair_id"]), v.shape, "msk").sum() for c in (6, 26)]
    assert sizes == [124, 97]


def shifted_pair(spark, shift=(1, 0, -1)):
    rng = np.random.default_rng(5)
    base = np.stack([box(rng.normal(size=(10, 10, 10)), 1) * 10 for _ in range(3)], -1)
    return volume_rows(spark, base[1:9, 1:9, 1:9]), volume_rows(spark, base[1 - shift[0] : 9 - shift[0], 1 - shift[1] : 9 - shift[1], 1 - shift[2] : 9 - shift[2]])


def test_convex_registration_finds_a_shift(spark):
    fixed, moving = shifted_pair(spark)
    field = registration.register(fixed, moving, grid=1, reach=1, inverse_rounds=0).where("d BETWEEN 3 AND 4 AND h BETWEEN 3 AND 4 AND w BETWEEN 3 AND 4")
    means = field.agg(*[F.avg(c) for c in ("ud", "uh", "uw")]).first()
    assert np.allclose(means, (1, 0, -1), atol=0.35)


def test_descent_lowers_the_cost(spark):
    fixed, moving = shifted_pair(spark, (1, 0, 0))
    sizes = grids.shapes(fixed, ["pair_id"])
    still = fixed.select("pair_id", "d", "h", "w", *[F.lit(0.0).alias(c) for c in ("ud", "uh", "uw")])

    def cost(field):
        moved = warp.trilinear_features(field, moving, sizes).withColumnRenamed("feat", "m")
        from voxlake.functions import vectors as V

        return moved.join(fixed, ["pair_id", "d", "h", "w"]).agg(F.avg(V.squared_distance(F.col("m"), F.col("feat")))).first()[0]

    assert cost(registration.descend(still, fixed, moving, weight=0.1, rounds=3, rate=0.2)) < 0.9 * cost(still)


def sample(volume, at, zero=False):
    """Trilinear values of volume (d, h, w, ...) at places (..., 3): the border beyond it, or zeros."""
    size = np.array(volume.shape[:3])
    if not zero:
        at = np.clip(at, 0, size - 1)
    low = np.floor(at).astype(int)
    out = 0.0
    for corner in itertools.product((0, 1), repeat=3):
        place = low + corner
        weight = np.prod(np.where(corner, at - low, 1 - (at - low)), -1)
        inside = ((place >= 0) & (place < size)).all(-1)
        found = volume[tuple(np.moveaxis(np.clip(place, 0, size - 1), -1, 0))]
        weight = weight * inside
        out = out + found * weight.reshape(weight.shape + (1,) * (found.ndim - weight.ndim))
    return out


def field_rows(spark, u):
    rows = [("p", d, h, w, *map(float, u[d, h, w])) for d, h, w in np.ndindex(u.shape[:3])]
    return spark.createDataFrame(rows, "pair_id string, d int, h int, w int, ud double, uh double, uw double")


def field_of(frame, shape):
    out = np.full((*shape, 3), np.nan)
    for r in frame.collect():
        out[r["d"], r["h"], r["w"]] = r["ud"], r["uh"], r["uw"]
    return out


def places(shape):
    return np.stack(np.meshgrid(*map(np.arange, shape), indexing="ij"), -1).astype(float)


def test_inverse_consistency(spark):
    rng = np.random.default_rng(4)
    shape = (5, 6, 4)
    f, b = (rng.normal(size=(*shape, 3)) for _ in range(2))
    found = registration.consistent(field_rows(spark, f), field_rows(spark, b), 3)
    at = places(shape)
    for _ in range(3):
        f, b = 0.5 * (f - sample(b, at + f, zero=True)), 0.5 * (b - sample(f, at + b, zero=True))
    assert np.allclose(field_of(found[0], shape), f) and np.allclose(field_of(found[1], shape), b)


@pytest.mark.parametrize("reach", [1, 2])
def test_costs(spark, reach, monkeypatch):
    monkeypatch.setattr(registration, "SLAB_COSTS", 6 * 5 * (2 * reach + 1) ** 3 * 2)  # slabs of two planes
    rng = np.random.default_rng(6)
    fixed, moving = (rng.normal(size=(7, 6, 5, 3)) for _ in range(2))
    wide = np.pad(moving, [(reach, reach)] * 3 + [(0, 0)])
    want = []
    for a, b, e in registration.offset_list(reach):
        cost = ((fixed - wide[a + reach : a + reach + 7, b + reach : b + reach + 6, e + reach : e + reach + 5]) ** 2).sum(-1)
        want.append(zero_box(zero_box(cost, 1), 1))
    found = registration.packed_costs(volume_rows(spark, fixed), volume_rows(spark, moving), reach).collect()
    assert len(found) == 210
    for r in found:
        assert np.allclose(r["costs"], [c[r["d"], r["h"], r["w"]] for c in want])


def adam(u, fixed, moving, weight, rounds, rate, loss, inner, every=0):
    slopes = np.stack([0.5 * (replicated(moving, 1, k) - replicated(moving, -1, k)) for k in range(3)], -1)
    at, m, v, n = places(u.shape[:3]), 0.0, 0.0, u[..., 0].size
    smooth = lambda x: np.stack([functools.reduce(lambda y, _: zero_box(y, 1), range(inner), x[..., k]) for k in range(3)], -1)
    for step in range(1, rounds + 1):
        now = smooth(u)
        moved, slope = sample(moving, at + now), sample(slopes, at + now)
        if loss == "ssd":
            e = 24 * (moved - fixed) / fixed.shape[-1] / n
        else:
            mc, fc = moved - moved.mean((0, 1, 2)), fixed - fixed.mean((0, 1, 2))
            sm, sf = np.sqrt((mc**2).mean((0, 1, 2))), np.sqrt((fc**2).mean((0, 1, 2)))
            below, cov = sm * sf + 1e-6, (mc * fc).mean((0, 1, 2))
            e = -12 / fixed.shape[-1] / n * (fc - mc * cov * sf / (sm * below)) / below
        g = (e[..., None] * slope).sum(-2)
        for k in range(3):
            for by in (1, -1):
                g = g + 2 * weight * (now - replicated(now, by, k)) / n
        g = smooth(g)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        u = u - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if every and step % every == 0:
            u = np.stack([zero_box(u[..., k], 1) for k in range(3)], -1)
    return u


@pytest.mark.parametrize(("loss", "inner"), [("ssd", 0), ("ncc", 0), ("ssd", 1), ("ncc", 2)])
def test_descent(spark, loss, inner):
    rng = np.random.default_rng(9)
    fixed, moving = (np.stack([box(rng.normal(size=(6, 5, 4)), 1) for _ in range(2)], -1) for _ in range(2))
    u = rng.normal(size=(6, 5, 4, 3)) * 0.3
    found = registration.descend(field_rows(spark, u), volume_rows(spark, fixed), volume_rows(spark, moving), 0.5, 2, 0.2, loss, inner)
    assert np.allclose(field_of(found, u.shape[:3]), adam(u, fixed, moving, 0.5, 2, 0.2, loss, inner), atol=1e-6)


@pytest.mark.parametrize(("loss", "inner", "every", "planes", "rounds"), [("ssd", 0, 0, 20, 7), ("ssd", 1, 2, 20, 5), ("ncc", 1, 2, 20, 3), ("ssd", 1, 3, 10, 4)])
def test_descent_by_slabs(spark, monkeypatch, loss, inner, every, planes, rounds):
    """Slabs of a few planes, several rounds in a task, fields that point far: the same as over whole volumes."""
    monkeypatch.setattr(descent, "SLAB_BYTES", planes * 8 * 12 * (5 * 2 + 24))
    monkeypatch.setattr(descent, "CHUNK", 50)
    rng = np.random.default_rng(4)
    fixed, moving = (np.stack([box(rng.normal(size=(26, 4, 3)), 1) for _ in range(2)], -1) for _ in range(2))
    u = rng.normal(size=(26, 4, 3, 3)) * 2
    found = descent.descend(field_rows(spark, u), volume_rows(spark, fixed), volume_rows(spark, moving), 0.5, rounds, 0.1, loss, inner, smooth_every=every)
    assert np.allclose(field_of(found, u.shape[:3]), adam(u, fixed, moving, 0.5, rounds, 0.1, loss, inner, every), atol=1e-6)


def test_schedule_of_slabs():
    """A volume that fits is one slab for all rounds; a larger one gets several rounds in a task, within the bytes that it may hold."""
    plan = descent.Descent(inner=3, rate=1.0)
    assert plan.schedule(64, 64 * 64, 2, 3.0, 0, 60) == (60, 64, 0, 0)
    count, depth, halo, reach = plan.schedule(256, 64 * 64, 12, 3.0, 0, 60)
    assert count > 1 and halo == 7 * count and reach >= 3 + count and depth < 256
    assert 8 * 64 * 64 * ((depth + 2 * halo) * (5 * 12 + 24) + 2 * reach * 4 * 12) <= descent.SLAB_BYTES
    assert plan.schedule(256, 2048 * 2048, 64, 3.0, 0, 60)[:2] == (1, 1)  # a plane at least
    rng = np.random.default_rng(2)
    for _ in range(20):  # whatever the gradients, no step of Adam is longer
        m = v = 0.0
        for step, g in enumerate(rng.normal(size=30) * 10.0 ** rng.integers(-6, 6, 30), 1):
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            assert abs(m / (1 - 0.9**step)) / np.sqrt(v / (1 - 0.999**step)) <= descent.adam_bound(step) + 1e-9


def test_sixty_rounds_over_a_large_pair(spark, monkeypatch):
    """60 rounds on 64^3 voxels in slabs equal plain numpy."""
    monkeypatch.setattr(descent, "SLAB_BYTES", 8 * 64 * 64 * 34 * 60)
    rng = np.random.default_rng(8)
    fixed, moving = (np.stack([box(box(rng.normal(size=(64, 64, 64)), 2), 1)], -1) for _ in range(2))
    u = np.zeros((64, 64, 64, 3))
    found = descent.descend(field_rows(spark, u), volume_rows(spark, fixed), volume_rows(spark, moving), 0.5, 60, 0.05, "ssd", 1)
    assert np.allclose(field_of(found, u.shape[:3]), adam(u, fixed, moving, 0.5, 60, 0.05, "ssd", 1), atol=1e-5)


def test_descent_needs_whole_planes(spark):
    fixed, moving = shifted_pair(spark)
    still = fixed.select("pair_id", "d", "h", "w", *[F.lit(0.0).alias(c) for c in ("ud", "uh", "uw")])
    with pytest.raises(Exception, match="isn't whole"):
        registration.descend(still.where("h <> 3 OR w <> 2"), fixed, moving, rounds=1).count()
    none = registration.descend(still.limit(0), fixed.limit(0), moving.limit(0), rounds=2)
    assert none.count() == 0 and none.columns == still.columns


def test_descent_snapshots(spark):
    fixed, moving = shifted_pair(spark, (1, 0, 0))
    still = fixed.select("pair_id", "d", "h", "w", *[F.lit(0.0).alias(c) for c in ("ud", "uh", "uw")])
    found = registration.descend(still, fixed, moving, rate=0.2, keep=(1, 3), inner=1, smooth_every=2)
    assert {(r["round"], r["count"]) for r in found.groupBy("round").count().collect()} == {(1, 512), (3, 512)}
    with pytest.raises(ValueError, match="ssd or ncc"):
        registration.descend(still, fixed, moving, rounds=1, loss="mi")


def test_two_stages(spark):
    rng = np.random.default_rng(11)
    base = np.stack([box(rng.normal(size=(18, 9, 9)), 1) * 10 for _ in range(2)], -1)
    fixed, moving = volume_rows(spark, base[:14]), volume_rows(spark, base[2:16])
    search = slice_search.SliceSearch(n_scales=3, smooth_matrix=0.0, smooth_scores=0.0)
    elastic = registration.Elastic(grid=1, reach=1, inverse_rounds=0, adam_grid=1, iters=(1,), smooths=(0, 1), rate=0.1)
    found = registration.TwoStage("trans", elastic, search, l2=True)(fixed, moving)
    means = {r["level"]: r["x"] for r in found.where("d BETWEEN 4 AND 10 AND h BETWEEN 3 AND 5 AND w BETWEEN 3 AND 5").groupBy("level").agg(F.avg("ud").alias("x")).collect()}
    assert set(means) == {"affine", "convex", "e1_s0", "e1_s1"}
    assert means["affine"] == pytest.approx(-2) and all(abs(x + 2) < 0.5 for x in means.values())
    alone = registration.dispatched("ca", registration.TwoStage("trans", elastic, search), {"convex": (fixed, moving), "adam": (fixed, moving)})
    assert {r["level"] for r in alone.select("level").distinct().collect()} == {"convex", "e1_s0", "e1_s1"}
    with pytest.raises(ValueError, match="missing"):
        registration.dispatched("gica", registration.TwoStage(), {"convex": (fixed, moving)})


def test_dispatched_with_an_affine_stage(spark):
    """`gica` is the two stages on its descriptors: the affine of the convex ones, then both levels; `scale` and `trans` keep their half."""
    rng = np.random.default_rng(11)
    base = np.stack([box(rng.normal(size=(18, 9, 9)), 1) * 10 for _ in range(2)], -1)
    fixed, moving = volume_rows(spark, base[:14]), volume_rows(spark, base[2:16])
    search = slice_search.SliceSearch(n_scales=3, smooth_matrix=0.0, smooth_scores=0.0)
    elastic = registration.Elastic(grid=1, reach=1, inverse_rounds=0, adam_grid=1, iters=(2,), smooths=(0,), rate=0.1)
    key = lambda rows: sorted((r["level"], r["d"], r["h"], r["w"], round(r["ud"], 6), round(r["uh"], 6), round(r["uw"], 6)) for r in rows.collect())
    stage = registration.TwoStage("trans", elastic, search)
    found = key(registration.dispatched("gica", stage, {"convex": (fixed, moving), "adam": (fixed, moving)}))
    assert found == key(stage(fixed, moving)) and {r[0] for r in found} == {"affine", "convex", "e2_s0"}
    affine = slice_search.refined(search, fixed, moving).first()
    of = lambda rows: next((r[4:] for r in rows if r[:4] == ("affine", 5, 4, 4)))
    assert of(found) == pytest.approx((affine["td"], affine["th"], affine["tw"]), abs=1e-6)
    scaled = key(registration.TwoStage("scale", registration.Elastic(grid=1, reach=1, inverse_rounds=0), search)(fixed, moving))
    assert of(scaled) == pytest.approx(((affine["sd"] - 1) * 5, (affine["sh"] - 1) * 4, (affine["sw"] - 1) * 4), abs=1e-6)
    given = spark.createDataFrame([("p", 1.0, 1.0, 1.0, 1.0, 0.0, -1.0)], "pair_id string, sd double, sh double, sw double, td double, th double, tw double")
    assert of(key(registration.TwoStage(given, registration.Elastic(grid=1, reach=1, inverse_rounds=0), search)(fixed, moving))) == (1.0, 0.0, -1.0)
    with pytest.raises(ValueError, match="affine stage"):
        registration.TwoStage("rigid", elastic, search)(fixed, moving)


def test_descriptor_of_masked_volumes(spark):
    """What is outside the mask is filled before the descriptor looks at it: a value there changes nothing."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(6, 6, 6))
    inside = np.zeros(v.shape, bool)
    inside[1:5, 1:6, :4] = True
    wild = np.where(inside, v, 1e6)
    rows = lambda x: volume_rows(spark, x).join(volume_rows(spark, inside.astype(float)).select("pair_id", "d", "h", "w", (F.col("value") > 0).alias("msk")), ["pair_id", "d", "h", "w"])
    found = [neighbourhood.masked_self_similarity(rows(x), 1, 1, ["pair_id"]) for x in (v, wild)]
    filled = neighbourhood.self_similarity(neighbourhood.filled_outside(rows(v), ["pair_id"]), 1, 1, ["pair_id"])
    a, b, c = ({(r["d"], r["h"], r["w"]): r["feat"] for r in x.collect()} for x in (*found, filled))
    assert len(a) == 216 and all(np.allclose(a[k], b[k]) and np.allclose(a[k], c[k]) for k in a)


def test_pooled_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(5, 4, 7, 3))
    found = grids.pooled_features(volume_rows(spark, x).repartition(9), 2, ["pair_id"]).collect()
    want = x[:4, :, :6].reshape(2, 2, 2, 2, 3, 2, 3).mean((1, 3, 5))
    assert len(found) == 12 and all(np.allclose(r["feat"], want[r["d"], r["h"], r["w"]]) for r in found)


def test_nearest_points(spark):
    rng = np.random.default_rng(12)
    every = [tuple(map(int, x)) for x in np.ndindex(9, 8, 7)]
    spacing = (1.5, 1.0, 0.5)
    for seed, share in ((1, 0.03), (2, 0.3)):
        rng = np.random.default_rng(seed)
        points = [p for p in every if rng.random() < share]
        queries = [p for p in every if rng.random() < 0.5]
        shape = "k string, d int, h int, w int"
        frame = lambda rows: spark.createDataFrame([("a", *r) for r in rows], shape)
        found = {(r["d"], r["h"], r["w"]): (r["distance"], (r["nd"], r["nh"], r["nw"])) for r in distance.nearest(frame(queries).unionByName(frame(queries[:3]).withColumn("k", F.lit("none"))), frame(points), ["k"], spacing).collect()}
        assert len(found) == len(queries)
        for q, (far, near) in found.items():
            want = min((round(sum(((a - b) * s) ** 2 for a, b, s in zip(q, p, spacing, strict=True)), 9), p) for p in points)
            assert far**2 == pytest.approx(want[0]) and near == want[1]


def test_extensions(spark):
    v = volume_rows(spark, np.random.default_rng(3).normal(size=(4, 4, 4)), "vid")
    for registry, name in ((extensions.projectors, "identity"), (extensions.samplers, "all"), (extensions.mask_generators, "self_similarity"), (extensions.registrations, "band_search"), (extensions.wrappers, "channels")):
        made = registry.get(name)
        assert registry.restored(registry.state(made)) == made and registry.get(made) is made and isinstance(made, registry.protocol)
        with pytest.raises(ValueError, match=name):
            registry.get("nothing")
    extensions.samplers.register("lazy", "voxlake.plans.extensions:EveryToken")
    assert extensions.samplers.get("lazy", masked=True) == extensions.EveryToken(True)
    t = v.select(F.array("value", F.col("value") * 2, "d").alias("feat"))
    fitted = extensions.projectors.get("pca", channels=2).fit(t)
    assert extensions.projectors.restored(extensions.projectors.state(fitted)) == fitted
    assert {len(r["feat"]) for r in extensions.projected(fitted, t).collect()} == {2}
    model = axes.ThreeAxes(patch=[2, 1, 2], every=2, channels=2, combine="sum").fit(v)
    again = extensions.three_axes_restored(extensions.three_axes_state(model))
    key = ["vid", "d", "h", "w"]
    assert [r["feat"] for r in model.transform(v).orderBy(*key).collect()] == [r["feat"] for r in again.transform(v).orderBy(*key).collect()]
    assert masks.routed("all", "descriptor") == {"feat": True, "affine": True, "elastic": True}
    with pytest.raises(ValueError, match="encoder"):
        masks.routed("feat", "encoder")


def test_slice_search_finds_a_shift(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(24, 3, 3, 2))
    search = slice_search.SliceSearch(n_scales=3, smooth_matrix=0.0, smooth_scores=0.0)
    found = search.axis(volume_rows(spark, base[:20]), volume_rows(spark, base[2:22]), "x").first()
    assert (found["scale"], found["shift"]) == (1.0, -2.0)


def test_identity_warps(spark, sf):
    v = vox(spark, sf).withColumnRenamed("vid", "pair_id")
    sizes = grids.shapes(v, ["pair_id"])
    still = warp.Affine().dense(sizes)
    key = ["pair_id", "d", "h", "w"]
    for found in (warp.nearest(still, v, sizes), warp.trilinear(still, v, sizes)):
        assert found.join(v.withColumnRenamed("value", "v"), key).where("abs(value - v) > 1e-9").count() == 0
        assert found.count() == v.count()


def test_affine_round_trip_and_rounding(spark):
    a = warp.Affine((1.1, 1.0, 0.5), (1.0, 2.0, -3.0))
    assert warp.Affine.from_matrix(a.matrix()) == a
    with pytest.raises(ValueError, match="scale and shift"):
        warp.Affine.from_matrix([[1, 1, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]])
    v = volume_rows(spark, np.arange(6.0).reshape(6, 1, 1))
    half = v.select("pair_id", "d", "h", "w", F.lit(0.5).alias("ud"), F.lit(0.0).alias("uh"), F.lit(0.0).alias("uw"))
    found = warp.nearest(half, v, grids.shapes(v, ["pair_id"])).orderBy("d").collect()
    assert [r["value"] for r in found] == [0, 2, 2, 4, 4, 5]  # halves go to the even voxel, the end is clamped


def test_three_axes(spark):
    v = volume_rows(spark, np.random.default_rng(3).normal(size=(5, 6, 7)), "vid")
    model = axes.ThreeAxes(patch=[2, 3, 2], every=2, channels=2).fit(v)
    out = model.transform(v).collect()
    assert len(out) == 210 and all(len(r["feat"]) == 6 and None not in r["feat"] for r in out)
    whole = axes.Axis("z", patch=1, every=1).transform(v).join(v, ["vid", "d", "h", "w"])
    assert whole.where("abs(feat[0] - value) > 1e-9").count() == 0
    assert axes.per_axis({"x": 1, "y": 2, "z": 3}) == {"x": 1, "y": 2, "z": 3}
    with pytest.raises(ValueError, match="axes"):
        axes.per_axis([1, 2])


def test_ladders():
    assert projection.ladder("uniform", 4) == [0.25] * 4
    assert projection.ladder([1.0, 3.0], 2) == [0.25, 0.75]
    assert json.loads(projection.PCA([0.0], [[1.0]], [1.0]).to_json())["kind"] == "pca"
    with pytest.raises(ValueError, match="weights"):
        projection.ladder([1.0], 2)


def test_descent_over_features_that_lack_voxels(spark):
    """They are 0 there, a whole plane among them."""
    fixed, moving = shifted_pair(spark, (1, 0, 0))
    still = fixed.select("pair_id", "d", "h", "w", *[F.lit(0.0).alias(c) for c in ("ud", "uh", "uw")])
    holes = "d = 2 OR d = 7 AND (h > 3 OR h = 3 AND w > 1)"
    zero = lambda x: x.withColumn("feat", F.when(F.expr(holes), F.transform("feat", lambda v: v * 0.0)).otherwise(F.col("feat")))
    found = registration.descend(still, fixed.where(f"NOT ({holes})"), moving.where(f"NOT ({holes})"), rounds=3, inner=1)
    want = registration.descend(still, zero(fixed), zero(moving), rounds=3, inner=1)
    assert np.allclose(field_of(found, (8, 8, 8)), field_of(want, (8, 8, 8)))


def test_features_warped_from_nowhere_are_zero(spark):
    """A target whose corners all lack a voxel has a vector of zeros, as long as the others."""
    source = spark.createDataFrame([("p", 0, 0, w, [1.0 + w, 2.0]) for w in (0, 1, 4)], "pair_id string, d int, h int, w int, feat array<double>")
    sizes = spark.createDataFrame([("p", 1, 1, 5)], "pair_id string, nd int, nh int, nw int")
    field = warp.Affine((1.0, 1.0, 1.0), (0.0, 0.0, 0.5)).dense(sizes)
    found = {r["w"]: r["feat"] for r in warp.trilinear_features(field, source, sizes).collect()}
    assert found == {0: [1.5, 2.0], 1: [1.0, 1.0], 2: [0.0, 0.0], 3: [2.5, 1.0], 4: [5.0, 2.0]}
