"""Gradient descent of displacement fields by slabs of planes.

A round needs the field and its moments within a few planes only: the means reach `inner` planes there and back, neighbour differences
one, a smoothing of the field one more. So a task takes the planes of a slab with a halo as wide as several rounds reach, does those
rounds in place, and returns the slab's own planes; halos are exchanged between. The moving features come with as many planes more as
the field may point to: its largest displacement so far, plus what Adam can add in the rounds (`adam_bound`). Planes are packed, one
row each, so what is shuffled grows with rounds / (rounds in a task) and not with voxels x corners x rounds. `schedule` chooses depth
and rounds by what a task may hold; volumes that fit whole need no exchange.

A loss with sums over whole volumes (ncc) exchanges after every round: slabs give partial sums, which are added up for each pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.operators.grids import XYZ, shapes
from voxlake.scratch import dropped, written

#: Bytes of planes that a task holds, about, and voxels that are sampled at once.
SLAB_BYTES, CHUNK = 192 << 20, 1 << 15
#: Rows of sizes (one for each pair) that are broadcast; more are joined by shuffle.
BROADCAST_PAIRS = 100_000
LOSSES = ("ssd", "ncc")
#: Decay of Adam's moments. Fixed values.
MEAN_DECAY, SQUARE_DECAY = 0.9, 0.999

_AT = ["pair_id", *XYZ]
_U = [f"u{c}" for c in XYZ]
_FIXED, _MOVING, _STATE, _SUMS = range(4)
_PLANE = "pair_id string, d int, nh int, nw int, data binary"
_OUT = f"{_PLANE}, round int, far double"


def mean3(x: np.ndarray) -> np.ndarray:
    """Means of 3^3 cells along the first three axes, zeros beyond the ends."""
    for axis in range(3):
        pad = [(1, 1) if k == axis else (0, 0) for k in range(x.ndim)]
        wide = np.pad(x, pad)
        take = lambda k: np.take(wide, np.arange(k, k + x.shape[axis]), axis)  # noqa: B023, E731
        x = (take(0) + take(1) + take(2)) / 3
    return x


def adam_bound(step: int) -> float:
    """The largest step of Adam at a rate of 1: by Cauchy and Schwarz, whatever the gradients were."""
    sums = sum((MEAN_DECAY**2 / SQUARE_DECAY) ** k for k in range(step))
    return (1 - MEAN_DECAY) * math.sqrt(sums / (1 - SQUARE_DECAY) * (1 - SQUARE_DECAY**step)) / (1 - MEAN_DECAY**step)


@dataclass(frozen=True)
class Descent:
    """weight: of the mean squared neighbour differences. inner: 3^3 means of the field before it is used. smooth_every: rounds after
    which the field itself is smoothed once, 0 for never."""

    weight: float = 1.0
    rate: float = 0.5
    loss: str = "ssd"
    inner: int = 0
    smooth_every: int = 0

    def __post_init__(self) -> None:
        if self.loss not in LOSSES:
            raise ValueError(f"a loss is ssd or ncc, not {self.loss!r}")

    def halo(self, first: int, rounds: int) -> int:
        """Planes beyond a slab that rounds first + 1 to first + rounds depend on."""
        return rounds * (2 * self.inner + 1) + ((first + rounds) // self.smooth_every - first // self.smooth_every if self.smooth_every else 0)

    def schedule(self, planes: int, area: int, channels: int, far: float, first: int, rounds: int) -> tuple[int, int, int, int]:
        """Rounds in a task, planes of a slab, planes of its halo, and planes more of the moving features; those of least shuffle
        for each round that SLAB_BYTES holds."""
        most = SLAB_BYTES // (8 * area)
        if planes * (5 * channels + 24) <= most:
            return rounds, planes, 0, 0
        best = None
        for count in range(1, 1 + (rounds if self.loss == "ssd" else 1)):
            halo = self.halo(first, count)
            reach = min(planes, math.ceil(far + self.rate * sum(adam_bound(s) for s in range(first + 1, first + count + 1))) + 2)
            depth = min(planes, (most - 2 * halo * (5 * channels + 24) - 2 * reach * 4 * channels) // (5 * channels + 24))
            if depth < 1 and best:
                break
            depth = max(depth, 1)
            sent = ((depth + 2 * halo) * (2 * channels + 9) + 2 * reach * channels) / (depth * count)
            if best is None or sent < best[0]:
                best = sent, (count, depth, halo, reach)
        return best[1]


class _Slab:
    """The planes that one task holds: arrays over (d, h, w, component), of which planes low to high of the volume."""

    def __init__(self, plan: Descent, depth: int, halo: int, reach: int, rows: pa.Table) -> None:
        self.plan = plan
        side, d = (rows.column(c).to_numpy() for c in ("side", "d"))
        plane = int(np.flatnonzero(side == _STATE)[0])
        self.pair, slab, self.planes, nh, nw = (rows.column(c)[plane].as_py() for c in ("pair_id", "slab", "nd", "nh", "nw"))
        self.own = range(slab * depth, min((slab + 1) * depth, self.planes))
        self.low, self.high = max(0, self.own.start - halo), min(self.planes, self.own.stop + halo)
        self.size = (nh, nw)

        def stacked(which: int, low: int, high: int) -> np.ndarray:
            held = {int(d[k]): np.frombuffer(rows.column("data")[int(k)].as_py(), np.float64).reshape(nh, nw, -1) for k in np.flatnonzero(side == which)}
            missing = [k for k in range(low, high) if k not in held]
            if missing and (which == _STATE or not held):
                raise ValueError(f"planes {missing[:5]} of pair {self.pair!r} are missing in one of field, fixed and moving features")
            none = np.zeros_like(next(iter(held.values())))
            return np.stack([held.get(k, none) for k in range(low, high)])

        self.fixed, self.state = stacked(_FIXED, self.low, self.high), stacked(_STATE, self.low, self.high)
        self.first = max(0, self.low - reach)
        moving = stacked(_MOVING, self.first, min(self.planes, self.high + reach))
        slopes = []
        for axis in range(3):
            n = moving.shape[axis]
            at = np.arange(n)
            slopes.append(0.5 * (np.take(moving, np.minimum(at + 1, n - 1), axis) - np.take(moving, np.maximum(at - 1, 0), axis)))
        self.source = np.concatenate([moving, *slopes], -1)
        sums = np.flatnonzero(side == _SUMS)
        self.sums = np.frombuffer(rows.column("data")[int(sums[0])].as_py(), np.float64).reshape(5, -1) if len(sums) else None

    @property
    def voxels(self) -> int:
        return self.planes * self.size[0] * self.size[1]

    def smooth(self, x: np.ndarray) -> np.ndarray:
        for _ in range(self.plan.inner):
            x = mean3(x)
        return x

    def sampled(self, now: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Features and slopes at x + u of the voxels of these flat numbers, the border clamped."""
        place = np.stack(np.unravel_index(at, now.shape[:3]), 1).astype(np.float64)
        place[:, 0] += self.low
        place = np.clip(place + now.reshape(-1, 3)[at], 0, np.array([self.planes, *self.size]) - 1.0)
        base = np.floor(place).astype(np.int64)
        part = place - base
        flat, out = self.source.reshape(-1, self.source.shape[-1]), 0.0
        for corner in range(8):
            weight, index = 1.0, 0
            for axis, (first, n) in enumerate(zip((self.first, 0, 0), self.source.shape[:3], strict=True)):
                up = corner >> axis & 1
                weight = weight * (part[:, axis] if up else 1 - part[:, axis])
                index = index * n + np.clip(base[:, axis] + up - first, 0, n - 1)
            out = out + weight[:, None] * flat[index]
        return out

    def moments(self, now: np.ndarray, planes: range) -> np.ndarray:
        """Sums over these planes of the sampled channels m, the fixed ones f, m^2, f^2 and m f."""
        c = self.fixed.shape[-1]
        numbers = np.arange((planes.start - self.low) * math.prod(self.size), (planes.stop - self.low) * math.prod(self.size))
        total = np.zeros((5, c))
        for at in np.array_split(numbers, max(1, -(-len(numbers) // CHUNK))):
            m, f = self.sampled(now, at)[:, :c], self.fixed.reshape(-1, c)[at]
            total += np.stack([x.sum(0) for x in (m, f, m * m, f * f, m * f)])
        return total

    def gradient(self, now: np.ndarray) -> np.ndarray:
        """Of twelve times the loss, and of the neighbour differences, by the field that is sampled. ssd: the mean squared difference
        over channels and voxels; ncc: one less the correlation of each channel over a pair's voxels, its mean over channels."""
        c = self.fixed.shape[-1]
        if self.plan.loss == "ncc":
            sums = self.moments(now, range(self.planes)) if self.sums is None else self.sums
            am, af, mm, ff, mf = sums / self.voxels
            sm, sf, cov = np.sqrt(np.maximum(mm - am * am, 0)), np.sqrt(np.maximum(ff - af * af, 0)), mf - am * af
            below = sm * sf + 1e-6
            # d ncc / d m = ((f - mean f) - (m - mean m) cov sf / (sm below)) / (voxels below)
            r = np.divide(cov * sf, sm * below, out=np.zeros(c), where=sm * below > 0)
        out = np.empty((now[..., 0].size, 3))
        for at in np.array_split(np.arange(len(out)), max(1, -(-len(out) // CHUNK))):
            s, f = self.sampled(now, at), self.fixed.reshape(-1, c)[at]
            if self.plan.loss == "ssd":
                e = 24.0 / c / self.voxels * (s[:, :c] - f)
            else:
                e = -12.0 / c / self.voxels * ((f - af) - (s[:, :c] - am) * r) / below
            out[at] = np.einsum("vc,vkc->vk", e, s[:, c:].reshape(len(at), 3, c))
        out = out.reshape(now.shape)
        for axis in range(3):
            step = np.diff(now, axis=axis) * (2.0 * self.plan.weight / self.voxels)
            ahead, behind = [slice(None)] * 4, [slice(None)] * 4
            ahead[axis], behind[axis] = slice(1, None), slice(None, -1)
            out[tuple(ahead)] += step
            out[tuple(behind)] -= step
        return out

    def round(self, step: int) -> np.ndarray:
        """One round of Adam in place; the smooth field that it started from."""
        u, m, v = (self.state[..., k : k + 3] for k in (0, 3, 6))
        now = self.smooth(u)
        g = self.smooth(self.gradient(now))
        m, v = MEAN_DECAY * m + (1 - MEAN_DECAY) * g, SQUARE_DECAY * v + (1 - SQUARE_DECAY) * g * g
        u = u - self.plan.rate * (m / (1 - MEAN_DECAY**step)) / (np.sqrt(v / (1 - SQUARE_DECAY**step)) + 1e-8)
        if self.plan.smooth_every and step % self.plan.smooth_every == 0:
            u = mean3(u)
        self.state = np.concatenate([u, m, v], -1)
        return now

    def planes_of(self, x: np.ndarray, round_: int) -> pa.Table:
        mine = x[self.own.start - self.low : self.own.stop - self.low]
        n, far = len(mine), float(np.abs(mine[..., 0]).max())
        return pa.table({
            "pair_id": pa.array([self.pair] * n, pa.string()), "d": pa.array([*self.own], pa.int32()),
            "nh": pa.array([self.size[0]] * n, pa.int32()), "nw": pa.array([self.size[1]] * n, pa.int32()),
            "data": pa.array([p.tobytes() for p in mine], pa.binary()), "round": pa.array([round_] * n, pa.int32()), "far": pa.array([far] * n, pa.float64()),
        })


def _pack(names: Sequence[str], sized: bool):
    """The voxels of one plane -> one row; lists and numbers of the columns stand one after the other for each voxel."""

    def run(rows: pa.Table) -> pa.Table:
        h, w = (rows.column(c).to_numpy().astype(np.int64) for c in ("h", "w"))
        nh, nw = (rows.column(c)[0].as_py() for c in ("nh", "nw")) if sized else (int(h.max()) + 1, int(w.max()) + 1)
        parts = []
        for name in names:
            values = rows.column(name).combine_chunks()
            values = values.flatten() if pa.types.is_list(values.type) else values
            parts.append(values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(h), -1))
        data = np.concatenate(parts, 1)
        place = h * nw + w
        if len(np.unique(place)) != len(h) or (len(h) != nh * nw and not sized):
            raise ValueError(f"plane {rows.column('d')[0]} of pair {rows.column('pair_id')[0]} isn't whole")
        out = np.zeros((nh * nw, data.shape[1]))
        out[place] = data
        return pa.table({"pair_id": rows.column("pair_id")[:1], "d": rows.column("d")[:1].cast(pa.int32()), "nh": pa.array([nh], pa.int32()), "nw": pa.array([nw], pa.int32()), "data": pa.array([out.tobytes()], pa.binary())})

    return run


def packed(volume: DataFrame, names: Sequence[str], sizes: DataFrame | None = None) -> DataFrame:
    """One row for each plane of volume(pair_id, d, h, w, names): pair_id, d, nh, nw, data. A plane that isn't whole is an error; with
    sizes(pair_id, nh, nw) planes have these sizes and zeros for voxels that aren't there."""
    rows = volume.select(*_AT, *names)
    if sizes is not None:
        rows = rows.join(sizes.select("pair_id", "nh", "nw"), "pair_id")
    return rows.groupBy("pair_id", "d").applyInArrow(_pack(names, sizes is not None), _PLANE)


def unpacked(planes: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """pair_id, d, h, w, the field, and other columns of packed planes whose first three components are a field."""
    kinds = dict(planes.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                data = np.frombuffer(row["data"], np.float64).reshape(row["nh"] * row["nw"], -1)
                h, w = np.divmod(np.arange(len(data)), row["nw"])
                repeat = lambda name, n=len(data), row=row: pa.array([row[name]]).take(pa.array(np.zeros(n, np.int64)))
                columns = [repeat("pair_id").cast(pa.string()), repeat("d").cast(pa.int32()), pa.array(h.astype(np.int32)), pa.array(w.astype(np.int32))]
                columns += [pa.array(np.ascontiguousarray(data[:, c])) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, *(repeat(m).cast(pa.int32()) for m in more)], [*_AT, *_U, *more])

    shape = ", ".join(["pair_id string", *(f"{c} int" for c in XYZ), *(f"{u} double" for u in _U), *(f"{m} {kinds[m]}" for m in more)])
    return planes.mapInArrow(run, shape)


def _advance(plan: Descent, depth: int, halo: int, reach: int, first: int, rounds: int, keep: Sequence[int]):
    def run(rows: pa.Table) -> pa.Table:
        slab = _Slab(plan, depth, halo, reach, rows)
        out = []
        for step in range(first + 1, first + rounds + 1):
            now = slab.round(step)
            if step in keep:
                out.append(slab.planes_of(now, step))
        return pa.concat_tables([*out, slab.planes_of(slab.state, 0)])

    return run


def _moments(plan: Descent, depth: int, halo: int, reach: int):
    def run(rows: pa.Table) -> pa.Table:
        slab = _Slab(plan, depth, halo, reach, rows)
        sums = slab.moments(slab.smooth(slab.state[..., :3]), slab.own)
        return pa.table({"pair_id": pa.array([slab.pair], pa.string()), "data": pa.array([sums.tobytes()], pa.binary())})

    return run


def _added(rows: pa.Table) -> pa.Table:
    sums = np.sum([np.frombuffer(x.as_py(), np.float64) for x in rows.column("data")], 0)
    return pa.table({"pair_id": rows.column("pair_id")[:1], "data": pa.array([sums.tobytes()], pa.binary())})


def descend(
    field: DataFrame, fixed: DataFrame, moving: DataFrame, weight: float = 1.0, rounds: int = 10, rate: float = 0.5,
    loss: str = "ssd", inner: int = 0, keep: Sequence[int] = (), smooth_every: int = 0,
) -> DataFrame:
    """Adam over twelve times the loss of the features and, times weight, the mean over voxels of the field's squared neighbour
    differences. A round smooths the field by `inner` 3^3 means, samples the moving features and their central differences at
    x + u, forms the gradient, takes it back through the means (which are their own transpose), and moves u; every `smooth_every`
    rounds u itself is smoothed once. keep: rounds whose smoothed fields are returned, with a column `round`; none: the last
    round's field, as it stands. The field is on whole grids; a plane that isn't is an error. Features that lack voxels of the grid are 0
    there. An empty table gives an empty one."""
    plan = Descent(weight, rate, loss, inner, smooth_every)
    grid = written(shapes(field, ["pair_id"]), "descent-sizes")
    within = [x.join(grid.select("pair_id", *[F.col(f"n{c}").alias(f"_n{c}") for c in XYZ]), "pair_id").where(" AND ".join(f"{c} < _n{c}" for c in XYZ)) for x in (fixed, moving)]
    features = [written(packed(x, ["feat"], grid), "descent-features") for x in within]
    state = written(packed(field.select(*_AT, *_U, *[F.lit(0.0).alias(f"_{k}") for k in range(6)]), [*_U, *(f"_{k}" for k in range(6))]).withColumns({"round": F.lit(0), "far": F.lit(None).cast("double")}), "descent")
    far = field.agg(F.max(F.abs("ud"))).first()[0] or 0.0
    channels_of = features[0].groupBy("pair_id").agg(F.max(F.octet_length("data") / (8 * F.col("nh") * F.col("nw"))).cast("int").alias("channels"))
    sizes = written(grid.join(channels_of, "pair_id").select("pair_id", "nd", "channels", (F.col("nh") * F.col("nw")).alias("area")), "descent-sizes")
    pairs, planes, area, channels = sizes.agg(F.count(F.lit(1)), *[F.coalesce(F.max(c), F.lit(1)) for c in ("nd", "area", "channels")]).first()
    small = F.broadcast(sizes.select("pair_id", "nd")) if pairs <= BROADCAST_PAIRS else sizes.select("pair_id", "nd")
    last = max(keep) if keep else rounds
    kept, done = [], 0
    while done < last:
        count, depth, halo, reach = plan.schedule(planes, area, channels, far, done, last - done)

        def cut(rows: DataFrame, side: int, beyond: int, depth: int = depth) -> DataFrame:
            ends = [F.floor((F.col("d") + x) / depth).cast("int") for x in (-beyond, beyond)]
            ends = F.greatest(ends[0], F.lit(0)), F.least(ends[1], F.floor((F.col("nd") - 1) / depth).cast("int"))
            return rows.join(small, "pair_id").where("d < nd").select("pair_id", F.lit(side).alias("side"), "d", "nd", "nh", "nw", "data", F.explode(F.sequence(*ends)).alias("slab"))

        slabs = cut(features[0], _FIXED, halo).unionByName(cut(features[1], _MOVING, halo + reach)).unionByName(cut(state.where("round = 0"), _STATE, halo))
        if loss == "ncc" and depth < planes:
            sums = slabs.groupBy("pair_id", "slab").applyInArrow(_moments(plan, depth, halo, reach), "pair_id string, data binary")
            sums = written(sums.groupBy("pair_id").applyInArrow(_added, "pair_id string, data binary"), "descent-sums")
            dealt = sums.join(small, "pair_id").select("pair_id", F.lit(_SUMS).alias("side"), F.lit(-1).alias("d"), "nd", F.lit(0).alias("nh"), F.lit(0).alias("nw"), "data", F.explode(F.sequence(F.lit(0), F.floor((F.col("nd") - 1) / depth).cast("int"))).alias("slab"))
            slabs = slabs.unionByName(dealt)
        else:
            sums = None
        now = written(slabs.groupBy("pair_id", "slab").applyInArrow(_advance(plan, depth, halo, reach, done, count, keep), _OUT), "descent")
        kept += [now] if any(done < k <= done + count for k in keep) else []
        dropped(*([state] if state not in kept else []), *([sums] if sums is not None else []))
        state, done = now, done + count
        far = state.where("round = 0").agg(F.max("far")).first()[0] or 0.0
    dropped(*features, grid, sizes)
    if not keep:
        return unpacked(state.where("round = 0"))
    out = [unpacked(table.where("round > 0"), ["round"]) for table in kept]
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole
