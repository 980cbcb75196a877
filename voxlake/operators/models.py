"""Bases of image models, as functions of whole batches: how slices are laid out for them, patch transformers over slices, and
convolutions over volumes.

Weights are arrays by name, read from one file (`read_weights`) and broadcast after a check of their size; none belong to this library. A
model is a small description that Spark sends with a task; `stream` and `convolved` run it where the slices and slabs are.
"""

from __future__ import annotations

import io
import math
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.operators.descent import packed
from voxlake.operators.grids import shapes

#: Bytes of weights that are broadcast.
MAX_WEIGHT_BYTES = 4 << 30
POLICIES = ("none", "pad_to_patch", "resize_to_fixed")
Weights = Mapping[str, np.ndarray]


def read_weights(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """The arrays of one .npz file, by any path that Spark reads. Its size is checked before its content is asked for."""
    files = spark.read.format("binaryFile").load(path)
    sizes = [r["length"] for r in files.select("length").collect()]
    if len(sizes) != 1 or sizes[0] > MAX_WEIGHT_BYTES:
        raise ValueError(f"{path!r} must be one file of at most {MAX_WEIGHT_BYTES} bytes, not {sizes}")
    with np.load(io.BytesIO(files.select("content").first()["content"]), allow_pickle=False) as found:
        return {name: found[name].astype(np.float64) for name in found.files}


def shared(spark: SparkSession, weights: Weights) -> Broadcast:
    size = sum(w.nbytes for w in weights.values())
    if size > MAX_WEIGHT_BYTES:
        raise ValueError(f"weights have {size} bytes; at most {MAX_WEIGHT_BYTES} are broadcast")
    return spark.sparkContext.broadcast({k: np.asarray(v, np.float64) for k, v in weights.items()})


def bilinear(x: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """x(..., rows, cols, channels) at another size: half-pixel centres, the border clamped."""
    for axis, new in ((-3, size[0]), (-2, size[1])):
        old = x.shape[axis]
        if old == new:
            continue
        at = np.maximum((np.arange(new) + 0.5) * (old / new) - 0.5, 0)
        low = np.minimum(np.floor(at).astype(int), old - 1)
        t = (at - np.floor(at))[:, None]
        t = t if axis == -2 else t[:, None]
        x = np.take(x, low, axis) * (1 - t) + np.take(x, np.minimum(low + 1, old - 1), axis) * t
    return x


@dataclass(frozen=True)
class Layout:
    """How a model takes slices. patch: pixels of a token's side, which alone decide the token grid. stride: what sides must be a multiple
    of. policy: `none` (other sides are an error), `pad_to_patch` (padded with the background, the larger half before), or
    `resize_to_fixed` (brought to `image`, always the tokens `grid`)."""

    patch: int
    policy: str = "none"
    stride_factor: int = 1
    image: tuple[int, int] | None = None
    grid: tuple[int, int] | None = None
    channels: int = 3
    mean: float = 0.0
    std: float = 1.0

    def __post_init__(self) -> None:
        if self.policy not in POLICIES:
            raise ValueError(f"{self.policy!r} is none of {POLICIES}")
        fixed = self.policy == "resize_to_fixed"
        if fixed != (self.image is not None) or fixed != (self.grid is not None):
            raise ValueError("a fixed image and grid are given if and only if slices are resized to them")
        if self.patch < 1 or self.stride_factor < 1 or self.std <= 0:
            raise ValueError("patch, stride factor and deviation are above 0")

    @property
    def stride(self) -> int:
        return self.patch * self.stride_factor

    def token_grid(self, rows: int, cols: int) -> tuple[int, int] | None:
        """The tokens of prepared slices; None where sides aren't whole patches."""
        if self.grid:
            return self.grid
        return None if rows % self.patch or cols % self.patch else (rows // self.patch, cols // self.patch)

    def prepared(self, x: np.ndarray, background: float = 0.0) -> np.ndarray:
        """Gray slices (n, rows, cols) as (n, rows, cols, channels)."""
        if x.ndim != 3:
            raise ValueError(f"slices are (n, rows, cols), not {x.shape}")
        if self.policy == "pad_to_patch":
            need = [-n % self.stride for n in x.shape[1:]]
            x = np.pad(x, [(0, 0), *((n - n // 2, n // 2) for n in need)], constant_values=background)
        x = x[..., None]
        if self.policy == "resize_to_fixed":
            x = bilinear(x, self.image)
        elif x.shape[1] % self.stride or x.shape[2] % self.stride:
            raise ValueError(f"sides {x.shape[1:3]} aren't multiples of {self.stride}")
        return np.repeat((x - self.mean) / self.std, self.channels, -1)


def _checked(weights: Weights, name: str, *shape: int | None) -> np.ndarray:
    if name not in weights:
        raise ValueError(f"weights have no {name!r}; there are {sorted(weights)[:20]}")
    found = weights[name]
    if len(found.shape) != len(shape) or any(want is not None and want != got for want, got in zip(shape, found.shape, strict=True)):
        raise ValueError(f"{name!r} has shape {found.shape}, not {shape}")
    return found


def patches(x: np.ndarray, patch: int) -> np.ndarray:
    """(n, rows, cols, c) -> (n, rows / patch, cols / patch, patch * patch * c)."""
    n, rows, cols, c = x.shape
    cut = x.reshape(n, rows // patch, patch, cols // patch, patch, c)
    return cut.transpose(0, 1, 3, 2, 4, 5).reshape(n, rows // patch, cols // patch, -1)


def _normed(x: np.ndarray, scale: np.ndarray, shift: np.ndarray, eps: float = 1e-6) -> np.ndarray:
    centred = x - x.mean(-1, keepdims=True)
    return centred / np.sqrt((centred**2).mean(-1, keepdims=True) + eps) * scale + shift


def _gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x**3)))


def _soft(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@dataclass(frozen=True)
class PatchTransformer:
    """Patch projection (one matrix product a batch), a position table resampled to the grid at hand, class and register tokens if there
    are weights for them, and blocks of attention and two layers. Weights: patch.weight (width, patch, patch, channels), patch.bias,
    position (rows, cols, width), class (width), registers (count, width), blocks.K.{norm1,norm2}.{scale,shift}, blocks.K.qkv.{weight,bias}
    (3 width, width), blocks.K.{out,fc1,fc2}.{weight,bias}, norm.{scale,shift}."""

    layout: Layout
    width: int
    blocks: int = 0
    heads: int = 1

    def outputs(self) -> tuple[str, ...]:
        """What can be tapped: the projection, every block and the normed last tokens, over the grid."""
        return ("patch", *(f"block{k}" for k in range(self.blocks)), "tokens")

    def __call__(self, weights: Weights, slices: np.ndarray, background: float = 0.0) -> dict[str, np.ndarray]:
        """Each output as (n, grid rows, grid cols, width); and `class` (n, width) and `registers` (n, count, width) if there are any."""
        x = self.layout.prepared(slices, background)
        p, c = self.layout.patch, self.layout.channels
        kernel = _checked(weights, "patch.weight", self.width, p, p, c)
        grid = patches(x, p) @ kernel.reshape(self.width, -1).T + _checked(weights, "patch.bias", self.width)
        want = self.layout.token_grid(*x.shape[1:3])
        if want != grid.shape[1:3]:
            raise ValueError(f"tokens are {grid.shape[1:3]} where {want} are expected")
        if "position" in weights:
            grid = grid + bilinear(_checked(weights, "position", None, None, self.width), grid.shape[1:3])
        out = {"patch": grid}
        n, gh, gw, _ = grid.shape
        first = [np.broadcast_to(weights[k].reshape(-1, self.width), (n, weights[k].size // self.width, self.width)) for k in ("class", "registers") if k in weights]
        before = sum(f.shape[1] for f in first)
        t = np.concatenate([*first, grid.reshape(n, gh * gw, self.width)], 1)
        dense = lambda x, name, size: x @ _checked(weights, f"{name}.weight", size, None).T + _checked(weights, f"{name}.bias", size)
        norm = lambda x, name: _normed(x, _checked(weights, f"{name}.scale", self.width), _checked(weights, f"{name}.shift", self.width))
        for k in range(self.blocks):
            name = f"blocks.{k}"
            qkv = dense(norm(t, f"{name}.norm1"), f"{name}.qkv", 3 * self.width).reshape(n, t.shape[1], 3, self.heads, -1).transpose(2, 0, 3, 1, 4)
            weight = _soft(qkv[0] @ qkv[1].swapaxes(-1, -2) / math.sqrt(self.width // self.heads))
            t = t + dense((weight @ qkv[2]).transpose(0, 2, 1, 3).reshape(t.shape), f"{name}.out", self.width)
            hidden = weights[f"{name}.fc1.bias"].size
            t = t + dense(_gelu(dense(norm(t, f"{name}.norm2"), f"{name}.fc1", hidden)), f"{name}.fc2", self.width)
            out[f"block{k}"] = t[:, before:].reshape(grid.shape)
        last = norm(t, "norm") if "norm.scale" in weights else t
        out["tokens"] = last[:, before:].reshape(grid.shape)
        if "class" in weights:
            out["class"] = last[:, 0]
        if "registers" in weights:
            out["registers"] = last[:, "class" in weights : before]
        return out


@dataclass(frozen=True)
class VolumeConvolution:
    """Layers of 3-D convolutions over whole volumes, zeros beyond them, negative values cut to 0 between layers. Weights:
    layers.K.weight (out, side, side, side, in) with odd sides, layers.K.bias."""

    layers: int

    def reach(self, weights: Weights) -> int:
        """Voxels on a side that one voxel's result depends on."""
        return sum(weights[f"layers.{k}.weight"].shape[1] // 2 for k in range(self.layers))

    def __call__(self, weights: Weights, volume: np.ndarray, present: np.ndarray | None = None) -> np.ndarray:
        """present (d, h, w): which voxels there are; others are 0 in every layer, as what is beyond the volume."""
        x = volume if present is None else np.where(present[..., None], volume, 0.0)
        for k in range(self.layers):
            kernel = _checked(weights, f"layers.{k}.weight", None, None, None, None, x.shape[-1])
            r = [s // 2 for s in kernel.shape[1:4]]
            if any(s % 2 == 0 for s in kernel.shape[1:4]):
                raise ValueError("kernels have odd sides")
            wide = np.pad(x, [*((n, n) for n in r), (0, 0)])
            out = np.zeros((*x.shape[:3], kernel.shape[0])) + _checked(weights, f"layers.{k}.bias", kernel.shape[0])
            for a, b, e in np.ndindex(*kernel.shape[1:4]):
                out += wide[a : a + x.shape[0], b : b + x.shape[1], e : e + x.shape[2]] @ kernel[:, a, b, e].T
            x = np.maximum(out, 0) if k + 1 < self.layers else out
            x = x if present is None else np.where(present[..., None], x, 0.0)
        return x


def convolved(model: VolumeConvolution, weights: Weights, volumes: DataFrame, key: str = "vid", value: str = "value", depth: int = 16) -> DataFrame:
    """key, d, h, w, feat of every voxel of volumes(key, d, h, w, value): slabs of `depth` planes, each with the planes that its results
    depend on. Nulls are 0; voxels that a volume lacks are as those beyond it; an empty table gives an empty one."""
    spark = volumes.sparkSession
    held, reach = shared(spark, weights), model.reach(weights)
    voxels = volumes.select(F.col(key).cast("string").alias("pair_id"), "d", "h", "w", F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_v"), F.lit(1.0).alias("_there"))
    planes = packed(voxels, ["_v", "_there"], shapes(voxels, ["pair_id"]))
    ends = [F.floor((F.col("d") + x) / depth).cast("int") for x in (-reach, reach)]
    rows = planes.select("*", F.explode(F.sequence(F.greatest(ends[0], F.lit(0)), ends[1])).alias("slab"))

    def run(part: pa.Table) -> pa.Table:
        d, slab, nh, nw = (part.column(c).to_numpy() for c in ("d", "slab", "nh", "nw"))
        first = int(d.min())
        x = np.zeros((int(d.max()) + 1 - first, nh[0], nw[0], 2))
        for k, plane in enumerate(d - first):
            x[plane] = np.frombuffer(part.column("data")[k].as_py(), np.float64).reshape(nh[0], nw[0], 2)
        there = x[..., 1] > 0
        own = there.copy()
        own[: max(0, slab[0] * depth - first)] = own[max(0, (slab[0] + 1) * depth - first) :] = False
        out = model(held.value, x[..., :1], there)[own]
        at = np.argwhere(own) + (first, 0, 0)
        ends = pa.array(np.arange(0, out.size + 1, out.shape[-1]).astype(np.int32))
        names = pa.array([part.column("pair_id")[0].as_py()] * len(at), pa.string())
        return pa.table({key: names, **{c: pa.array(at[:, k].astype(np.int32)) for k, c in enumerate("dhw")}, "feat": pa.ListArray.from_arrays(ends, pa.array(out.ravel()))})

    return rows.groupBy("pair_id", "slab").applyInArrow(run, f"{key} string, d int, h int, w int, feat array<double>")
