"""Model bases and streaming extraction against plain numpy, and against extraction first and projection after it."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.operators import models, projection, streaming

RNG = np.random.default_rng(12)
SMALL = models.Layout(2, "pad_to_patch", channels=1)


def slice_rows(spark, arrays, code=None):
    rows = [("v", "x", s, int(r), int(c), float(a[r, c]), code if code is None else int(code[s])) for s, a in enumerate(arrays) for r, c in np.ndindex(a.shape)]
    return spark.createDataFrame(rows, "vid string, dim string, slice_idx int, row int, col int, value double, mod_code int")


def transformer(width=6, blocks=2, heads=2, patch=2, channels=1, registers=2):
    w = {"patch.weight": RNG.normal(size=(width, patch, patch, channels)), "patch.bias": RNG.normal(size=width), "position": RNG.normal(size=(2, 3, width)), "class": RNG.normal(size=width), "registers": RNG.normal(size=(registers, width)), "norm.scale": RNG.normal(size=width), "norm.shift": RNG.normal(size=width)}
    for k in range(blocks):
        for name in ("norm1", "norm2"):
            w[f"blocks.{k}.{name}.scale"], w[f"blocks.{k}.{name}.shift"] = RNG.normal(size=width), RNG.normal(size=width)
        for name, shape in (("qkv", (3 * width, width)), ("out", (width, width)), ("fc1", (2 * width, width)), ("fc2", (width, 2 * width))):
            w[f"blocks.{k}.{name}.weight"], w[f"blocks.{k}.{name}.bias"] = RNG.normal(size=shape) * 0.3, RNG.normal(size=shape[0])
    return models.PatchTransformer(models.Layout(patch, "pad_to_patch", channels=channels), width, blocks, heads), w


def test_patches_are_a_convolution():
    model = models.PatchTransformer(models.Layout(3, channels=2, mean=0.5, std=2.0), 4)
    w = {"patch.weight": RNG.normal(size=(4, 3, 3, 2)), "patch.bias": RNG.normal(size=4)}
    x = RNG.normal(size=(2, 6, 9))
    found = model(w, x)["tokens"]
    assert found.shape == (2, 2, 3, 4)
    for n, y, z, k in np.ndindex(found.shape):
        part = (x[n, 3 * y : 3 * y + 3, 3 * z : 3 * z + 3] - 0.5) / 2.0
        assert found[n, y, z, k] == pytest.approx(sum((part * w["patch.weight"][k, :, :, c]).sum() for c in range(2)) + w["patch.bias"][k])


def test_blocks_by_plain_loops():
    """Every token of one slice by sums over tokens, heads and channels."""
    model, w = transformer()
    x = RNG.normal(size=(1, 4, 6))
    found = model(w, x)
    t = [w["class"], *w["registers"], *(found["patch"].reshape(-1, 6))]

    def norm(v, name):
        v = v - v.mean()
        return v / math.sqrt((v * v).mean() + 1e-6) * w[f"{name}.scale"] + w[f"{name}.shift"]

    def dense(v, name):
        return w[f"{name}.weight"] @ v + w[f"{name}.bias"]

    for k in range(2):
        qkv = [dense(norm(v, f"blocks.{k}.norm1"), f"blocks.{k}.qkv") for v in t]
        mixed = []
        for a in qkv:
            out = []
            for h in range(2):
                at = lambda v, part, h=h: v[6 * part + 3 * h : 6 * part + 3 * h + 3]
                e = np.array([math.exp(at(a, 0) @ at(b, 1) / math.sqrt(3)) for b in qkv])
                out += [(e / e.sum()) @ np.array([at(b, 2) for b in qkv])]
            mixed.append(np.concatenate(out))
        t = [v + dense(m, f"blocks.{k}.out") for v, m in zip(t, mixed, strict=True)]
        for i, v in enumerate(t):
            y = dense(norm(v, f"blocks.{k}.norm2"), f"blocks.{k}.fc1")
            y = np.array([0.5 * a * (1 + math.tanh(math.sqrt(2 / math.pi) * (a + 0.044715 * a**3))) for a in y])
            t[i] = v + dense(y, f"blocks.{k}.fc2")
        assert np.allclose(found[f"block{k}"].reshape(-1, 6), t[3:])
    last = [norm(v, "norm") for v in t]
    assert np.allclose(found["class"][0], last[0]) and np.allclose(found["registers"][0], last[1:3]) and np.allclose(found["tokens"].reshape(-1, 6), last[3:])


def test_layouts():
    x = RNG.normal(size=(1, 5, 7))
    padded = models.Layout(2, "pad_to_patch", 2, channels=3).prepared(x, 9.0)
    assert padded.shape == (1, 8, 8, 3) and np.allclose(padded[0, 2:7, 1:8, 1], x[0]) and (padded[0, :2] == 9).all() and (padded[0, 7] == 9).all()
    fixed = models.Layout(2, "resize_to_fixed", image=(4, 6), grid=(2, 3), channels=1)
    assert fixed.prepared(x).shape == (1, 4, 6, 1) and fixed.token_grid(99, 99) == (2, 3)
    assert models.Layout(2, stride_factor=2).token_grid(6, 8) == (3, 4) and models.Layout(4).token_grid(6, 8) is None
    for make, text in ((lambda: models.Layout(2, "crop"), "none of"), (lambda: models.Layout(2, "resize_to_fixed"), "if and only if"), (lambda: models.Layout(2, grid=(1, 1)), "if and only if"), (lambda: models.Layout(2).prepared(x), "multiples of 2"), (lambda: models.Layout(2).prepared(x[0]), "not")):
        with pytest.raises(ValueError, match=text):
            make()
    model, w = transformer()
    for name, bad in (("patch.weight", np.zeros((6, 2, 2, 2))), ("position", np.zeros((2, 3))), ("blocks.0.qkv.weight", np.zeros((6, 6)))):
        with pytest.raises(ValueError, match=name):
            model(w | {name: bad}, np.zeros((1, 4, 6)))
    with pytest.raises(ValueError, match="no 'patch.bias'"):
        model({k: v for k, v in w.items() if k != "patch.bias"}, np.zeros((1, 4, 6)))


def test_position_tables_fit_any_grid():
    table = RNG.normal(size=(2, 3, 4))
    assert np.allclose(models.bilinear(table, (2, 3)), table)
    found = models.bilinear(table, (5, 4))
    for r, c in np.ndindex(5, 4):
        y, x = max((r + 0.5) * 2 / 5 - 0.5, 0), max((c + 0.5) * 3 / 4 - 0.5, 0)
        want = sum(wy * wx * table[min(int(y) + dy, 1), min(int(x) + dx, 2)] for dy, wy in ((0, 1 - y % 1), (1, y % 1)) for dx, wx in ((0, 1 - x % 1), (1, x % 1)))
        assert np.allclose(found[r, c], want)


def test_weights_from_a_file(spark, tmp_path, monkeypatch):
    _, w = transformer()
    np.savez(tmp_path / "w.npz", **w)
    found = models.read_weights(spark, (tmp_path / "w.npz").as_uri())
    assert sorted(found) == sorted(w) and all(np.allclose(found[k], w[k]) for k in w)
    monkeypatch.setattr(models, "MAX_WEIGHT_BYTES", 100)
    with pytest.raises(ValueError, match="at most 100"):
        models.read_weights(spark, (tmp_path / "w.npz").as_uri())
    with pytest.raises(ValueError, match="at most 100"):
        models.shared(spark, w)


@pytest.mark.parametrize("micro", [1, 3, 16])
def test_streamed_is_extracted_then_projected(spark, micro):
    """Two taps from one pass, a projection by code among them, equal each tap's tokens extracted first and projected by expressions."""
    model, w = transformer()
    arrays = [RNG.normal(size=(4, 6)) for _ in range(5)] + [RNG.normal(size=(3, 5)) for _ in range(3)]
    packed = streaming.packed_slices(slice_rows(spark, arrays, [0, 1, 2, 0, 1, 0, 1, 2]))
    pca = projection.PCA(RNG.normal(size=6).tolist(), RNG.normal(size=(2, 6)).tolist(), [0.5, 0.5], unit=True)
    wpls = projection.WPLS(RNG.normal(size=(6, 3)).tolist(), RNG.normal(size=(6, 3)).tolist(), [1.0, 1.0, 1.0], RNG.normal(size=6).tolist(), None)
    found = streaming.stream(packed, model, w, {"block0": pca, "tokens": wpls}, micro=micro).collect()
    got = {(r["tap"], r["slice_idx"], r["tok_y"], r["tok_x"]): r["feat"] for r in found}
    raw = {tap: streaming.stream(packed, model, w, {tap: None}) for tap in ("block0", "tokens")}
    want = [("block0", raw["block0"].withColumn("feat", pca.transform(F.col("feat")))), ("tokens", wpls.transform(raw["tokens"]))]
    rows = {(tap, r["slice_idx"], r["tok_y"], r["tok_x"]): r["feat"] for tap, frame in want for r in frame.collect()}
    assert len(found) == len(got) == len(rows) and set(got) == set(rows)
    assert all(np.allclose(got[k], rows[k]) for k in got)
    one = model(w, np.stack(arrays[5:6]))["block0"][0, 1, 2]
    assert np.allclose(next(r["feat"] for r in raw["block0"].where("slice_idx = 5 AND tok_y = 1 AND tok_x = 2").collect()), one)


def test_plans_choose_slices_and_tokens(spark):
    model, w = transformer()
    calls = spark.sparkContext.accumulator(0)

    def counting(weights, batch, background):
        calls.add(len(batch))
        return model(weights, batch, background)

    packed = streaming.packed_slices(slice_rows(spark, [RNG.normal(size=(4, 6)) for _ in range(6)]))
    plan = spark.createDataFrame([("v", 1, 0, 0), ("v", 1, 1, 2), ("v", 4, 1, 1), ("v", 1, 0, 0), ("w", 0, 0, 0)], "vid string, slice_idx int, tok_y int, tok_x int")
    found = streaming.stream(packed, counting, w, {"patch": None}, plan).collect()
    assert sorted((r["slice_idx"], r["tok_y"], r["tok_x"]) for r in found) == [(1, 0, 0), (1, 1, 2), (4, 1, 1)] and calls.value == 2
    with pytest.raises(Exception, match="beyond the grid"):
        streaming.stream(packed, model, w, {"patch": None}, plan.limit(1).withColumn("tok_x", F.lit(3))).collect()
    with pytest.raises(Exception, match="no tokens 'class'"):
        streaming.stream(packed, model, w, {"class": None}).collect()
    assert streaming.stream(packed, model, w, {"patch": None}, plan.limit(0)).collect() == []
    assert streaming.stream(streaming.packed_slices(slice_rows(spark, [np.zeros((2, 2))]).limit(0)), model, w, {"patch": None}).collect() == []


def test_fitting_from_one_pass(spark):
    """Components of two taps from partial moments equal those of extracted tokens; a projector may fit itself to the batch."""
    model, w = transformer()
    packed = streaming.packed_slices(slice_rows(spark, [RNG.normal(size=(6, 6)) for _ in range(7)]))
    found = streaming.fitted(packed, model, w, {"block1": 3, "patch": 2})
    for tap, nc in (("block1", 3), ("patch", 2)):
        want = projection.PCA.fit(streaming.stream(packed, model, w, {tap: None}), nc)
        assert np.allclose(found[tap].mean, want.mean) and np.allclose(found[tap].components, want.components, atol=1e-6) and np.allclose(found[tap].explained, want.explained)

    class Own:
        channels = 2

        def __init__(self, model):
            self.model = model

        def fit_batch(self, slices, tap):
            return self.model

    fitted = streaming.fit_taps(packed, model, w, {"patch": Own(None), "block0": Own("mine"), "tokens": None})
    assert fitted["block0"] == "mine" and fitted["tokens"] is None and np.allclose(fitted["patch"].components, found["patch"].components, atol=1e-6)
    with pytest.raises(ValueError, match="no tokens to fit"):
        streaming.fitted(packed.limit(0), model, w, {"patch": 2})


def test_slices_are_packed_whole(spark):
    rows = slice_rows(spark, [np.arange(6.0).reshape(2, 3)])
    backgrounds = spark.createDataFrame([("v", 7.0)], "vid string, bg double")
    row = streaming.packed_slices(rows.withColumn("value", F.when(F.col("col") != 1, F.col("value"))), backgrounds).first()
    assert np.frombuffer(row["data"]).tolist() == [0.0, 7.0, 2.0, 3.0, 7.0, 5.0] and (row["rows"], row["cols"], row["bg"]) == (2, 3, 7.0)
    for bad in (rows.where("row <> 0 OR col <> 1"), rows.unionByName(rows.limit(1))):
        with pytest.raises(Exception, match="isn't whole"):
            streaming.packed_slices(bad).collect()


@pytest.mark.parametrize("depth", [1, 2, 100])
def test_convolutions_of_volumes(spark, depth):
    w = {"layers.0.weight": RNG.normal(size=(3, 3, 3, 3, 1)), "layers.0.bias": RNG.normal(size=3), "layers.1.weight": RNG.normal(size=(2, 5, 1, 3, 3)), "layers.1.bias": RNG.normal(size=2)}
    model = models.VolumeConvolution(2)
    assert model.reach(w) == 3
    volume = RNG.normal(size=(7, 4, 5))
    x = volume[..., None]
    for k, r in ((0, (1, 1, 1)), (1, (2, 0, 1))):
        wide = np.pad(x, [*((n, n) for n in r), (0, 0)])
        kernel = w[f"layers.{k}.weight"]
        x = np.array([[[[(wide[d : d + kernel.shape[1], h : h + kernel.shape[2], c : c + kernel.shape[3]] * kernel[o]).sum() + w[f"layers.{k}.bias"][o] for o in range(len(kernel))] for c in range(5)] for h in range(4)] for d in range(7)])
        x = np.maximum(x, 0) if k == 0 else x
    rows = spark.createDataFrame([("v", *map(int, at), float(volume[at])) for at in np.ndindex(volume.shape)], "vid string, d int, h int, w int, value double")
    found = models.convolved(model, w, rows, depth=depth).collect()
    assert len(found) == volume.size and all(np.allclose(r["feat"], x[r["d"], r["h"], r["w"]]) for r in found)
    assert models.convolved(model, w, rows.limit(0)).collect() == []
    with pytest.raises(ValueError, match="odd"):
        models.VolumeConvolution(1)({"layers.0.weight": np.zeros((1, 2, 2, 2, 1)), "layers.0.bias": np.zeros(1)}, volume[..., None])


def test_convolution_of_volumes_that_lack_voxels(spark):
    """Voxels that aren't there, a whole plane among them, are 0 in every layer and have no result."""
    volume, there = RNG.normal(size=(6, 4, 3)), RNG.random((6, 4, 3)) > 0.3
    there[3], there[5, 2:], there[0, 3, 2] = False, False, True
    w = {"layers.0.weight": RNG.normal(size=(2, 3, 3, 3, 1)), "layers.0.bias": RNG.normal(size=2), "layers.1.weight": RNG.normal(size=(1, 3, 3, 3, 2)), "layers.1.bias": RNG.normal(size=1)}
    model = models.VolumeConvolution(2)
    first = model.__class__(1)({k: v for k, v in w.items() if "0" in k[:8]}, np.where(there, volume, 0)[..., None])
    want = model.__class__(1)({k.replace("1", "0", 1): v for k, v in w.items() if "1" in k[:8]}, np.maximum(first, 0) * there[..., None])
    rows = spark.createDataFrame([("a", *map(int, at), float(volume[at])) for at in np.ndindex(volume.shape) if there[at]], "vid string, d int, h int, w int, value double")
    found = models.convolved(model, w, rows, depth=2).collect()
    assert len(found) == there.sum() and all(np.allclose(r["feat"], want[r["d"], r["h"], r["w"]]) for r in found)


def test_slices_that_lack_pixels(spark):
    """They get the size of their entity's other slices, and the background."""
    rows = slice_rows(spark, [np.arange(6.0).reshape(2, 3) + k for k in range(2)]).where("slice_idx = 0 OR row = 0 AND col < 2")
    backgrounds = rows.select("vid").distinct().withColumn("bg", F.lit(-7.0))
    found = {r["slice_idx"]: np.frombuffer(r["data"]).reshape(r["rows"], r["cols"]).tolist() for r in streaming.packed_slices(rows, backgrounds, partial=True).collect()}
    assert found == {0: [[0, 1, 2], [3, 4, 5]], 1: [[1, 2, -7], [-7, -7, -7]]}
    with pytest.raises(Exception, match="isn't whole"):
        streaming.packed_slices(rows.unionByName(rows), partial=True).collect()
