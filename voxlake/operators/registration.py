"""Elastic registration by a discrete cost volume, as tables.

Costs are summed in slabs: a task holds a few planes of both feature volumes with what the offsets and means reach beyond
them, and gives every voxel one row with its costs at all offsets. The convex rounds alternate between the cheapest offset near
the smooth field, voxel by voxel, and smoothing by windows. Each round is a written table, so plans stay short and a lost
executor costs one round; a table goes when the next one is written. Fields are (pair_id, d, h, w, ud, uh, uw).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field as _field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.functions import vectors as V
from voxlake.operators import features, slice_search, warp
from voxlake.operators.descent import descend, mean3
from voxlake.operators.grids import XYZ, full, holes, pooled_features, shapes
from voxlake.operators.neighbourhood import box_mean
from voxlake.scratch import dropped, written

#: Weights of the smooth field in the convex rounds. Fixed values.
COEFFICIENTS = (0.003, 0.01, 0.03, 0.1, 0.3, 1.0)
#: Costs that a task holds at once, about.
SLAB_COSTS = 1 << 23
_AT = ["pair_id", *XYZ]
_U = [f"u{c}" for c in XYZ]


def offset_list(reach: int) -> list[tuple[int, int, int]]:
    """All offsets of a cube, in order."""
    side = range(-reach, reach + 1)
    return [(a, b, e) for a in side for b in side for e in side]


def _slab(reach: int, depth: int, means: int):
    """Both sides' voxels of one slab and its surroundings -> the costs of its own voxels of the fixed side."""

    def run(rows: pa.Table) -> pa.Table:
        side, d, h, w, slab, nh, nw = (rows.column(c).to_numpy().astype(np.int64) for c in ("side", "d", "h", "w", "slab", "nh", "nw"))
        feat = rows.column("feat").combine_chunks()
        feat = feat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(side), -1)
        first, size = slab[0] * depth - means, (depth + 2 * means, int(nh[0]), int(nw[0]))
        fixed = np.zeros((*size, feat.shape[1]))
        moving = np.zeros((*(n + 2 * reach for n in size), feat.shape[1]))
        own = (side == 0) & (d >= first) & (d < first + size[0])
        fixed[d[own] - first, h[own], w[own]] = feat[own]
        other = side == 1
        moving[d[other] - first + reach, h[other] + reach, w[other] + reach] = feat[other]
        absent = np.ones(size, bool)
        absent[d[own] - first, h[own], w[own]] = False
        mine = np.flatnonzero(own & (d >= slab * depth) & (d < (slab + 1) * depth))
        costs = np.empty((len(mine), (2 * reach + 1) ** 3))
        for k, offset in enumerate(offset_list(reach)):
            a, b, e = (o + reach for o in offset)
            cost = ((fixed - moving[a : a + size[0], b : b + size[1], e : e + size[2]]) ** 2).sum(-1)
            for _ in range(means):
                cost[absent] = 0
                cost = mean3(cost)
            costs[:, k] = cost[d[mine] - first, h[mine], w[mine]]
        ends = pa.array(np.arange(0, costs.size + 1, costs.shape[1]).astype(np.int32))
        kept = rows.select(["pair_id", "d", "h", "w"]).take(pa.array(mine))
        return kept.append_column("costs", pa.ListArray.from_arrays(ends, pa.array(costs.ravel())))

    return run


def packed_costs(fixed: DataFrame, moving: DataFrame, reach: int, means: int = 2) -> DataFrame:
    """pair_id, d, h, w, costs: for each voxel the squared feature differences at every offset of `offset_list` (zeros beyond the
    volume), after 3^3 means. fixed, moving: (pair_id, d, h, w, feat) on one grid; moving voxels that aren't there have zeros, fixed ones
    no costs."""
    sizes = shapes(fixed, ["pair_id"])
    widest = sizes.agg(F.coalesce(F.max(F.col("nh") * F.col("nw")), F.lit(1))).first()[0]
    depth = max(1, SLAB_COSTS // (widest * (2 * reach + 1) ** 3))

    def cut(volume: DataFrame, side: int, beyond: int) -> DataFrame:
        ends = [F.floor((F.col("d") + x) / depth).cast("int") for x in (-beyond, beyond)]
        last = F.floor((F.col("nd") - 1) / depth).cast("int")
        rows = volume.select(*_AT, F.col("feat").cast("array<double>").alias("feat")).join(sizes, "pair_id")
        return rows.select(F.lit(side).alias("side"), *_AT, "feat", "nd", "nh", "nw", F.explode(F.sequence(F.greatest(ends[0], F.lit(0)), F.least(ends[1], last))).alias("slab"))

    both = cut(fixed, 0, means).unionByName(cut(moving.join(sizes.select("pair_id"), "pair_id", "left_semi"), 1, means + reach).where("d < nd AND h < nh AND w < nw"))
    return both.groupBy("pair_id", "slab").applyInArrow(_slab(reach, depth, means), "pair_id string, d int, h int, w int, costs array<double>")


def cost_volume(fixed: DataFrame, moving: DataFrame, reach: int) -> DataFrame:
    """The same costs by rows: pair_id, d, h, w, od, oh, ow, cost."""
    offsets = F.array(*[F.struct(*[F.lit(v).alias(f"o{c}") for c, v in zip(XYZ, o, strict=True)]) for o in offset_list(reach)])
    rows = packed_costs(fixed, moving, reach).select(*_AT, F.explode(F.arrays_zip(F.col("costs").alias("cost"), offsets.alias("o"))).alias("x"))
    return rows.select(*_AT, *[F.col(f"x.o.o{c}").alias(f"o{c}") for c in XYZ], F.col("x.cost").alias("cost"))


def cheapest(costs: DataFrame, cost: Column) -> DataFrame:
    """Each voxel's offset of least cost, ties to the first in order, as a field. costs: by rows."""
    order = F.struct(cost.alias("c"), *[F.col(f"o{c}") for c in XYZ])
    return costs.groupBy(*_AT).agg(F.min(order).alias("b")).select(*_AT, *[F.col(f"b.o{c}").cast("double").alias(f"u{c}") for c in XYZ])


def _chosen(reach: int, weight: float):
    table = np.array(offset_list(reach), np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            costs = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            if weight:
                at = np.stack([batch.column(5 + k).to_numpy(zero_copy_only=False) for k in range(3)], 1)
                costs = costs + weight * ((table[None] - at[:, None]) ** 2).sum(2)
            found = table[costs.argmin(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(found[:, k]) for k in range(3))], [*_AT, *_U])

    return run


def chosen(costs: DataFrame, reach: int, near: DataFrame | None = None, weight: float = 0.0) -> DataFrame:
    """Each voxel's offset of least cost as a field; with near, costs plus weight times the squared distance from that field."""
    rows = costs.join(near, _AT) if near is not None else costs.withColumns({u: F.lit(0.0) for u in _U})
    return rows.select(*_AT, "costs", *_U).mapInArrow(_chosen(reach, weight if near is not None else 0.0), "pair_id string, d int, h int, w int, ud double, uh double, uw double")


def convex(costs: DataFrame, reach: int, coefficients: Sequence[float] = COEFFICIENTS) -> DataFrame:
    """The coupled rounds over packed costs: a smooth field in voxels of the coarse grid."""
    lacking = written(holes(costs, ["pair_id"]), "holes")
    smooth = written(box_mean(chosen(costs, reach), _U, ["pair_id"], lacking=lacking), "convex")
    for weight in coefficients:
        now = written(box_mean(chosen(costs, reach, smooth, weight), _U, ["pair_id"], lacking=lacking), "convex")
        dropped(smooth)
        smooth = now
    dropped(lacking)
    return smooth


def consistent(forward: DataFrame, backward: DataFrame, rounds: int = 15) -> tuple[DataFrame, DataFrame]:
    """Both fields moved towards each other's inverse: f <- (f - b(x + f)) / 2 and likewise; zeros beyond the volume."""
    names = [f"u{c}" for c in XYZ]
    sizes = written(shapes(forward, ["pair_id"]), "sizes")

    def step(a: DataFrame, b: DataFrame) -> DataFrame:
        moved = warp.trilinear(a, b, sizes, names, boundary="zero").select(*_AT, *[F.col(n).alias(f"_{n}") for n in names])
        return a.join(moved, _AT).select(*_AT, *[(0.5 * (F.col(n) - F.col(f"_{n}"))).alias(n) for n in names])

    for _ in range(rounds):
        ahead, back = written(step(forward, backward), "forward"), written(step(backward, forward), "backward")
        dropped(forward, backward)
        forward, backward = ahead, back
    return forward, backward


def upsampled(field: DataFrame, factor: int, sizes: DataFrame) -> DataFrame:
    """A coarse field on the full grid of sizes(pair_id, nd, nh, nw): values grow by the factor, sampled at half-pixel centres."""
    coarse = shapes(field, ["pair_id"])
    grid = full(sizes, ("pair_id",)).select(*_AT)
    place = [((F.col(c) + 0.5) / factor - 0.5 - F.col(c)).alias(f"u{c}") for c in XYZ]
    names = [f"u{c}" for c in XYZ]
    moved = warp.trilinear(grid.select(*_AT, *place), field, coarse, names)
    return moved.select(*_AT, *[(F.col(n) * factor).alias(n) for n in names])


def smoothing_levels(fields: DataFrame, counts: Sequence[int]) -> DataFrame:
    """fields(pair_id, level, d, h, w, ud, uh, uw) after each of the counts of smoothings (three 3^3 means each), as levels
    `{level}_s{count}`."""
    out, keys = None, ["pair_id", "level"]
    now = fields.select(*keys, *XYZ, *_U)
    lacking = written(holes(now, keys), "holes") if max(counts) else None
    for count in range(max(counts) + 1):
        if count:
            now = written(box_mean(now, _U, keys, times=3, lacking=lacking), "smoothing")
        if count in counts:
            part = now.withColumn("level", F.concat("level", F.lit(f"_s{count}")))
            out = part if out is None else out.unionByName(part)
    return out


@dataclass(frozen=True)
class Elastic:
    """The convex rounds and the descent after them. iters: rounds of the descent whose fields are levels `e{rounds}`, none for
    the convex level only; smooths: counts of smoothings, each a level `e{rounds}_s{count}`."""

    grid: int = 4
    reach: int = 4
    inverse_rounds: int = 15
    adam_grid: int = 2
    weight: float = 0.75
    rate: float = 1.0
    loss: str = "ssd"
    inner: int = 3
    smooth_every: int = 0
    iters: tuple[int, ...] = ()
    smooths: tuple[int, ...] = (0,)

    def _levels(self, fixed: DataFrame, moving: DataFrame, fine: tuple[DataFrame, DataFrame]) -> DataFrame:
        f, m = (written(pooled_features(x, self.grid, ["pair_id"]), "coarse") for x in (fixed, moving))
        ahead = convex(written(packed_costs(f, m, self.reach), "costs"), self.reach)
        if self.inverse_rounds:
            back = convex(written(packed_costs(m, f, self.reach), "costs"), self.reach)
            ahead, _ = consistent(ahead, back, self.inverse_rounds)
        sizes = shapes(fixed, ["pair_id"])
        coarse = written(upsampled(ahead, self.grid, sizes), "convex-full")
        out = coarse.withColumn("level", F.lit("convex"))
        if self.iters:
            f, m = (written(pooled_features(x, self.adam_grid, ["pair_id"]), "coarse") for x in fine)
            start = downsampled(coarse, self.adam_grid)
            fields = descend(start, f, m, self.weight, rate=self.rate, loss=self.loss, inner=self.inner, keep=self.iters, smooth_every=self.smooth_every)
            for step in self.iters:
                part = written(upsampled(fields.where(F.col("round") == step).drop("round"), self.adam_grid, sizes), "descent-full")
                out = out.unionByName(smoothing_levels(part.withColumn("level", F.lit(f"e{step}")), self.smooths).select(*out.columns))
        return out.select("pair_id", "level", *XYZ, *_U)

    def __call__(self, fixed: DataFrame, moving: DataFrame, init: DataFrame | None = None, fine: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
        """pair_id, level, d, h, w, ud, uh, uw of fixed and moving(pair_id, d, h, w, feat). init, a field, warps the moving
        features first, and every level is that of the fitted field and then init. fine: features of the descent, where they
        are others than the convex rounds'."""
        fine = fine or (fixed, moving)
        if init is None:
            return self._levels(fixed, moving, fine)
        sizes = written(shapes(moving, ["pair_id"]), "sizes")
        ahead = [written(warp.trilinear_features(init, x, sizes), "warped") for x in (moving, fine[1])]
        return ladder(init, self._levels(fixed, ahead[0], (fine[0], ahead[1])), sizes).where("level <> 'affine'")


def downsampled(field: DataFrame, factor: int) -> DataFrame:
    """A field in a grid `factor` times coarser, sampled at the coarse voxels' centres; its values shrink by the factor."""
    sizes = shapes(field, ["pair_id"])
    coarse = sizes.select("pair_id", *[F.expr(f"cast(n{c} div {factor} as int)").alias(f"n{c}") for c in XYZ])
    grid = full(coarse, ("pair_id",)).select(*_AT)
    place = [((F.col(c) + 0.5) * factor - 0.5 - F.col(c)).alias(f"u{c}") for c in XYZ]
    moved = warp.trilinear(grid.select(*_AT, *place), field, sizes, _U)
    return moved.select(*_AT, *[(F.col(n) / factor).alias(n) for n in _U])


def register(fixed: DataFrame, moving: DataFrame, grid: int = 2, reach: int = 2, inverse_rounds: int = 3, adam_rounds: int = 0, weight: float = 1.0, smoothing: int = 0) -> DataFrame:
    """pair_id, level, d, h, w, ud, uh, uw of every pair: level `convex`, and `adam` where its rounds aren't 0."""
    found = Elastic(grid, reach, inverse_rounds, 1, weight, 0.5, inner=0, iters=(adam_rounds,) if adam_rounds else (), smooths=(smoothing,))(fixed, moving)
    return found.withColumn("level", F.when(F.col("level") == "convex", F.col("level")).otherwise("adam"))


def ladder(affine_field: DataFrame, elastic: DataFrame, sizes: DataFrame) -> DataFrame:
    """The levels of a pair's displacement: affine, then each elastic level after it. elastic was fitted to moving features
    already warped by the affine, so fields compose."""
    out = affine_field.withColumn("level", F.lit("affine"))
    names = [r["level"] for r in elastic.select("level").distinct().orderBy("level").collect()]  # a handful, by parameters
    for name in names:
        part = warp.composed(elastic.where(F.col("level") == name).drop("level"), affine_field, sizes)
        out = out.unionByName(part.withColumn("level", F.lit(name)))
    return out


@dataclass(frozen=True)
class TwoStage:
    """An affine start, then elastic levels. affine: `search` (scales and shifts of every axis), `trans` (shifts alone), `scale` (no
    shifts), `none`, or a table of pair_id, sd, sh, sw, td, th, tw. use_mask: which stage reads masks (none, affine,
    elastic, both). l2: features are brought to length 1 and the field's weight becomes a tenth, as costs are smaller then."""

    affine: str | DataFrame = "search"
    elastic: Elastic = _field(default_factory=Elastic)
    search: slice_search.SliceSearch = _field(default_factory=slice_search.SliceSearch)
    rounds: int = 1
    l2: bool = False
    use_mask: str = "none"

    def _start(self, fixed: DataFrame, moving: DataFrame) -> DataFrame | None:
        if not isinstance(self.affine, str):
            return self.affine
        if self.affine == "none":
            return None
        if self.affine not in ("search", "trans", "scale"):
            raise ValueError(f"an affine stage is search, trans, scale, none or a table, not {self.affine!r}")
        found = slice_search.refined(self.search, fixed, moving, rounds=self.rounds)
        if self.affine == "trans":
            found = found.withColumns({f"s{c}": F.lit(1.0) for c in XYZ})
        if self.affine == "scale":
            found = found.withColumns({f"t{c}": F.lit(0.0) for c in XYZ})
        return found

    def __call__(self, fixed: DataFrame, moving: DataFrame, coarse: tuple[DataFrame, DataFrame] | None = None, fine: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
        """pair_id, level (affine unless there is none, convex, e{rounds}_s{count}), d, h, w, ud, uh, uw. fixed, moving:
        (pair_id, d, h, w, feat[, msk]). coarse, fine: features of the convex rounds and of the descent, where they are others."""
        if self.use_mask not in ("none", "affine", "elastic", "both"):
            raise ValueError(f"use_mask is none, affine, elastic or both, not {self.use_mask!r}")
        unit = lambda x: x.withColumn("feat", V.unit(F.col("feat"))) if self.l2 else x
        masked = lambda x, stage: features.masked(x) if self.use_mask in (stage, "both") and "msk" in x.columns else x
        start = self._start(*(unit(masked(x, "affine")) for x in (fixed, moving)))
        convex_sides = [unit(masked(x, "elastic")) for x in coarse or (fixed, moving)]
        fine_sides = tuple(unit(masked(x, "elastic")) for x in fine or coarse or (fixed, moving))
        stage = self.elastic if not self.l2 else Elastic(**{**self.elastic.__dict__, "weight": self.elastic.weight * 0.1})
        if start is None:
            return stage(*convex_sides, fine=fine_sides)
        sizes = written(shapes(fixed, ["pair_id"]), "sizes")
        init = written(slice_search.dense(start, sizes), "affine")
        levels = stage(*convex_sides, init=init, fine=fine_sides)
        return init.withColumn("level", F.lit("affine")).select(*levels.columns).unionByName(levels)


def dispatched(kind: str, stage: TwoStage, descriptors: Mapping[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Registration by descriptors of (fixed, moving) for the convex rounds and the descent: `gica` has an affine stage on the
    convex ones, `ca` has none."""
    if kind not in ("gica", "ca"):
        raise ValueError(f"a registration is gica or ca, not {kind!r}")
    missing = [k for k in ("convex", "adam") if k not in descriptors]
    if missing:
        raise ValueError(f"descriptors are missing: {missing}")
    if kind == "ca":
        stage = TwoStage("none", stage.elastic, stage.search, stage.rounds, stage.l2, stage.use_mask)
    return stage(*descriptors["convex"], coarse=descriptors["convex"], fine=descriptors["adam"])


def ladder_levels(found: DataFrame, mode: str = "ladder") -> DataFrame:
    """pair_id, step (0: none, 1: affine, 2: convex, 3: the last descent), level: the rungs that a pair's found displacements
    give; `match` has the first alone."""
    order = {"affine": 1, "convex": 2}
    none = found.select("pair_id").distinct().select("pair_id", F.lit(0).alias("step"), F.lit(None).cast("string").alias("level"))
    if mode == "match":
        return none
    if mode != "ladder":
        raise ValueError(f"a ladder is ladder or match, not {mode!r}")
    names = found.select("pair_id", "level").distinct()
    step = F.coalesce(*[F.when(F.col("level") == k, v) for k, v in order.items()], F.lit(3))
    # of several descents that with the most rounds, then smoothings
    rank = F.struct(*[F.coalesce(F.regexp_extract("level", pattern, 1).try_cast("int"), F.lit(-1)) for pattern in ("^e([0-9]+)", "_s([0-9]+)$")], "level")
    best = Window.partitionBy("pair_id", "step").orderBy(rank.desc())
    rungs = names.withColumn("step", step).withColumn("_n", F.row_number().over(best)).where("_n = 1").select("pair_id", "step", "level")
    return none.unionByName(rungs)
