"""Slice search: the scale and shift along one axis that best lay one volume's slices over another's.

All tables carry pair_id, so many pairs run at once. A matrix is (pair_id, i, j, value) with rows of the fixed and columns of
the moving volume's slices, a score table (pair_id, s, t, score).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlake.functions import vectors as V
from voxlake.operators.slices import PLANES
from voxlake.scratch import dropped, written

#: Cells and rows of a matrix whose scores a task makes at once, at most.
SCORE_CELLS, SCORE_ROWS = 1 << 20, 256
#: Slices of a block: a task makes the products of two blocks at once.
PRODUCT_SLICES = 256


def slice_vectors(voxels: DataFrame, axis: str, keys: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """keys, idx, line, place, feat: each slice along an axis, in lines of places with their features."""
    index, row, col = PLANES[axis]
    return voxels.select(*keys, F.col(index).alias("idx"), F.col(row).alias("line"), F.col(col).alias("place"), F.col("feat").cast("array<double>").alias("feat"))


def norms(vectors: DataFrame, keys: tuple[str, ...] = ("pair_id",), eps: float = 1e-10) -> DataFrame:
    return vectors.groupBy(*keys, "idx").agg((F.sqrt(F.sum(V.dot(F.col("feat"), F.col("feat")))) + eps).alias("norm"))


def _line_products(size: int):
    """One line of a block of slices of a with the same line of a block of b -> their products, packed, of the first ni and nj slices."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(_PACKED, (pa.string(), *[pa.int32()] * 4, pa.binary()), strict=True)})
        sides, width = [], 1 + max(int(x.column("place").to_numpy().max()) for x in (a, b))
        for side in (a, b):
            at = side.column("idx").to_numpy() % size
            feat = side.column("feat").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(side.num_rows, -1)
            lines = np.zeros((at.max() + 1, width, feat.shape[1]))
            lines[at, side.column("place").to_numpy()] = feat
            sides.append(lines.reshape(len(lines), -1))
        x, y = sides
        few = {c: a.column(c)[:1] for c in ("pair_id", "_a", "_b")}
        return pa.table({**few, "ni": pa.array([len(x)], pa.int32()), "nj": pa.array([len(y)], pa.int32()), "data": pa.array([(x @ y.T).tobytes()], pa.binary())})

    return run


def _sums(size: int):
    """The lines' products of two blocks of slices -> the cells of their sum that aren't 0."""

    def run(parts: pa.Table) -> pa.Table:
        total = np.zeros((size, size))
        for ni, nj, data in zip(parts.column("ni").to_pylist(), parts.column("nj").to_pylist(), parts.column("data"), strict=True):
            total[:ni, :nj] += np.frombuffer(data.as_buffer(), np.float64).reshape(ni, nj)
        i, j = np.nonzero(total)
        pair = parts.column("pair_id")[:1].take(pa.array(np.zeros(len(i), np.int64)))
        first = {c: parts.column(f"_{n}")[0].as_py() * size for c, n in (("i", "a"), ("j", "b"))}
        return pa.table({"pair_id": pair, "i": (i + first["i"]).astype(np.int32), "j": (j + first["j"]).astype(np.int32), "value": total[i, j]})

    return run


_PACKED = ("pair_id", "_a", "_b", "ni", "nj", "data")


def cosine_matrix(a: DataFrame, b: DataFrame, indexes_a: DataFrame, indexes_b: DataFrame, eps: float = 1e-10) -> DataFrame:
    """The cosine of every slice of a with every slice of b. One line of two blocks of slices of a pair is a task's matrix product, and
    two blocks' lines are summed up in one step, so no task holds a whole matrix; what is shuffled is each voxel once for each block of
    the other side, and then the lines' products, packed."""
    size_ = PRODUCT_SLICES
    block = F.floor(F.col("idx") / size_).cast("int")

    def lines(v: DataFrame, own: str, other: str, indexes: DataFrame, others: DataFrame):
        # columns of their own, as both sides may be one table
        v = v.select(*[F.col(c).alias(c) for c in ("pair_id", "line", "idx", "place", "feat")])
        met = others.groupBy("pair_id").agg(F.collect_set(block).alias("_met"))
        met = indexes.select(F.col("pair_id").alias("pair_id"), F.col("idx").alias("idx")).join(met, "pair_id").select("pair_id", "idx", block.alias(own), F.explode("_met").alias(other))
        return v.join(met, ["pair_id", "idx"]).select("pair_id", "line", "_a", "_b", "idx", "place", "feat").groupBy("pair_id", "line", "_a", "_b")

    sides = lines(a, "_a", "_b", indexes_a, indexes_b).cogroup(lines(b, "_b", "_a", indexes_b, indexes_a))
    parts = sides.applyInArrow(_line_products(size_), "pair_id string, _a int, _b int, ni int, nj int, data binary")
    sums = parts.groupBy("pair_id", "_a", "_b").applyInArrow(_sums(size_), "pair_id string, i int, j int, value double")
    size = lambda v, n: norms(v, eps=eps).select("pair_id", F.col("idx").alias(n), F.col("norm").alias(f"_{n}"))
    cells = indexes_a.select("pair_id", F.col("idx").alias("i")).join(indexes_b.select("pair_id", F.col("idx").alias("j")), "pair_id")
    found = cells.join(sums, ["pair_id", "i", "j"], "left").join(size(a, "i"), ["pair_id", "i"], "left").join(size(b, "j"), ["pair_id", "j"], "left")
    return found.select("pair_id", "i", "j", F.coalesce(F.col("value") / F.col("_i") / F.col("_j"), F.lit(0.0)).alias("value"))


def valid_slices(mask: DataFrame, axis: str) -> DataFrame:
    """pair_id, idx, valid: whether any voxel of a slice is in the mask."""
    return mask.groupBy("pair_id", F.col(PLANES[axis][0]).alias("idx")).agg(F.bool_or(F.coalesce("msk", F.lit(False))).alias("valid"))


def distinct_slices(matrix: DataFrame, share: float = 0.01, alike: int = 5) -> DataFrame:
    """pair_id, i, distinct: slices with fewer than `alike` slices (itself included) nearer than least + share of the range
    of cosine distances. matrix: a volume's slices with themselves."""
    rows = matrix.select("pair_id", "i", (1.0 - F.col("value")).alias("dist"))
    ends = rows.groupBy("pair_id").agg((F.min("dist") + share * (F.max("dist") - F.min("dist"))).alias("_th"))
    return rows.join(ends, "pair_id").groupBy("pair_id", "i").agg((F.sum((F.col("dist") < F.col("_th")).cast("int")) < alike).alias("distinct"))


def chosen_range(flags: DataFrame, start: float = 0.1, end: float = 0.1) -> DataFrame:
    """pair_id, first, last (exclusive), n: without indistinct slices at both ends and a further share of each; all slices
    where nothing is left."""
    sizes = flags.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("distinct"), F.col("i"))).alias("_a"), F.max(F.when(F.col("distinct"), F.col("i"))).alias("_b")
    )
    first = F.coalesce("_a", "n") + F.floor(F.col("n") * start)
    last = F.coalesce(F.col("_b") + 1, F.lit(0)) - F.floor(F.col("n") * end)
    cut = sizes.select("pair_id", "n", first.alias("first"), last.alias("last"))
    whole = F.col("first") >= F.col("last")
    return cut.select("pair_id", F.when(whole, 0).otherwise(F.col("first")).cast("int").alias("first"), F.when(whole, F.col("n")).otherwise(F.col("last")).cast("int").alias("last"), F.col("n").cast("int").alias("n"))


def kernel(sigma: float) -> list[tuple[int, float]]:
    radius = max(math.ceil(3 * sigma), 1)
    raw = {k: math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)}
    total = sum(raw.values())
    return [(k, v / total) for k, v in raw.items()]


def smoothed(cells: DataFrame, sigma: float, row: str = "i", col: str = "j", value: str = "value") -> DataFrame:
    """Separable Gaussian of a table of cells; null cells have no weight and stay null, weights are brought to sum 1."""
    if sigma <= 0:
        return cells
    taps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in kernel(sigma)])
    rows = cells.select("pair_id", row, col, F.coalesce(value, F.lit(0.0)).alias("_v"), F.col(value).isNotNull().cast("double").alias("_w"))
    for axis, other in ((col, row), (row, col)):
        spread = rows.select("pair_id", other, axis, "_v", "_w", F.explode(taps).alias("_tap")).select("pair_id", other, (F.col(axis) - F.col("_tap.k")).alias(axis), (F.col("_v") * F.col("_tap.w")).alias("_v"), (F.col("_w") * F.col("_tap.w")).alias("_w"))
        rows = spread.groupBy("pair_id", other, axis).agg(F.sum("_v").alias("_v"), F.sum("_w").alias("_w"))
    known = cells.where(F.col(value).isNotNull()).select("pair_id", row, col)
    out = known.join(rows, ["pair_id", row, col]).select("pair_id", row, col, F.when(F.col("_w") > 2.3e-15, F.col("_v") / F.col("_w")).alias(value))
    return cells.drop(value).join(out, ["pair_id", row, col], "left")


def _beside(rows: DataFrame, by: str, **whole: tuple) -> DataFrame:
    """rows with aggregates (function, column) of their whole matrix: first those of each row or column (by), one row each, then of
    these. Cells are joined by pair and row or column, so no task holds a whole matrix."""
    pair = Window.partitionBy("pair_id")
    few = rows.groupBy("pair_id", by).agg(*[f(c).alias(n) for n, (f, c) in whole.items()])
    return rows.join(few.select("pair_id", by, *[f(n).over(pair).alias(n) for n, (f, _) in whole.items()]), ["pair_id", by])


def reweighted(matrix: DataFrame, blend: bool = True, eps: float = 1e-10) -> DataFrame:
    """To [0, 1]; then the mean of row and column shares weighted by each other's sums, to [0, 1] again."""

    def unit(rows: DataFrame, by: str) -> DataFrame:
        span = F.col("_b") - F.col("_a")
        value = F.when(span > 0, (F.col("value") - F.col("_a")) / span).otherwise(F.col("value"))
        return _beside(rows, by, _a=(F.min, "value"), _b=(F.max, "value")).select("pair_id", "i", "j", value.alias("value"))

    rows = unit(matrix, "i")
    if not blend:
        return rows
    by_row, by_col = Window.partitionBy("pair_id", "i"), Window.partitionBy("pair_id", "j")
    rows = rows.withColumns({
        "_r": F.col("value") / F.greatest(F.sum("value").over(by_row), F.lit(eps)),
        "_c": F.col("value") / F.greatest(F.sum("value").over(by_col), F.lit(eps)),
    })
    rows = _beside(rows, "j", _sr=(F.sum, "_r"), _sc=(F.sum, "_c"))
    mixed = (F.col("_r") * F.col("_sc") + F.col("_c") * F.col("_sr")) / F.greatest(F.col("_sr") + F.col("_sc"), F.lit(eps))
    return unit(rows.select("pair_id", "i", "j", mixed.alias("value")), "j")


def scales(low: float = 0.95, high: float = 1.05, n: int = 101) -> list[float]:
    """Evenly spaced in the logarithm; the one nearest to 1 is 1."""
    a, b = math.log10(low), math.log10(high)
    out = [10 ** (a + (b - a) * k / max(n - 1, 1)) for k in range(n)]
    out[min(range(n), key=lambda k: abs(out[k] - 1))] = 1.0
    return out


def _block_scores(factors: list[float]):
    """Some rows of a matrix, and all shifts -> for each scale and shift the sum and number of the values along its line."""

    def run(cells: pa.Table, asked: pa.Table) -> pa.Table:
        shift = asked.column("shift").to_numpy()
        index, at = np.unique(cells.column("i").to_numpy(), return_inverse=True)
        width = asked.column("_nj")[0].as_py() if asked.num_rows else 1
        # a column more for what is beyond the matrix
        rows = np.full((len(index), width + 1), np.nan)
        rows[at, cells.column("j").to_numpy()] = cells.column("value").to_numpy(zero_copy_only=False)
        known = ~np.isnan(rows)
        rows = np.where(known, rows, 0.0)
        line = np.arange(len(index))[:, None]
        total, n = np.empty((len(factors), len(shift))), np.empty((len(factors), len(shift)), np.int64)
        for s, scale in enumerate(factors):
            j = np.rint(scale * index[:, None] + shift[None])
            j = np.where((j >= 0) & (j < width), j, width).astype(np.int64)
            total[s], n[s] = rows[line, j].sum(0), known[line, j].sum(0)
        every = pa.array(np.tile(np.arange(len(shift)), len(factors)))
        return pa.table({
            **{c: asked.column(c).take(every) for c in ("pair_id", "t", "shift")},
            "s": pa.array(np.repeat(np.arange(len(factors), dtype=np.int32), len(shift))), "total": pa.array(total.ravel()), "n": pa.array(n.ravel()),
        }).select(["pair_id", "s", "t", "shift", "total", "n"])

    return run


def scores(matrix: DataFrame, factors: list[float], shifts: DataFrame, min_overlap: float = 0.5) -> DataFrame:
    """pair_id, s, t, shift, score: the mean of the matrix along j = round-half-even(scale * i + shift), null where fewer
    columns than min_overlap of the smaller side are met. shifts(pair_id, t, shift); matrix indexes run from 0."""
    sizes = matrix.groupBy("pair_id").agg((F.max("i") + 1).alias("_ni"), (F.max("j") + 1).alias("_nj"))
    # rows of the matrix that a task holds together
    sizes = sizes.withColumn("_rows", F.greatest(F.least(F.floor(SCORE_CELLS / F.col("_nj")), F.lit(SCORE_ROWS)), F.lit(1)).cast("int"))
    cells = matrix.join(sizes.select("pair_id", "_rows"), "pair_id").select("pair_id", F.floor(F.col("i") / F.col("_rows")).cast("int").alias("block"), "i", "j", F.col("value").cast("double").alias("value"))
    blocks = F.explode(F.sequence(F.lit(0), F.floor((F.col("_ni") - 1) / F.col("_rows")).cast("int"))).alias("block")
    asked = shifts.join(sizes.select("pair_id", "_nj", blocks), "pair_id").select("pair_id", "block", "_nj", "t", "shift")
    kinds = dict(shifts.dtypes)
    shape = f"pair_id string, s int, t {kinds['t']}, shift {kinds['shift']}, total double, n long"
    # columns of their own, as shifts may come from the matrix
    cells, asked = (x.select(*[F.col(c).alias(c) for c in x.columns]).groupBy("pair_id", "block") for x in (cells, asked))
    parts = cells.cogroup(asked).applyInArrow(_block_scores(factors), shape)
    out = parts.groupBy("pair_id", "s", "t", "shift").agg(F.sum("total").alias("_total"), F.sum("n").alias("_n")).join(sizes, "pair_id")
    least = min_overlap * F.least("_ni", "_nj")
    return out.select("pair_id", "s", "t", "shift", F.when((F.col("_n") >= least) & (F.col("_n") > 0), F.col("_total") / F.col("_n")).alias("score"))


def best(score_rows: DataFrame, factors: list[float], weight: float = 0.05) -> DataFrame:
    """pair_id, s, t, shift, scale: the largest blend of the score on [0, 1] and of how near the scale is to 1; ties go to the
    smaller scale index, then shift index."""
    spark = score_rows.sparkSession
    logs = [abs(math.log(f)) for f in factors]
    near = [(max(logs) - x) / max(logs) if max(logs) > 0 else 1.0 for x in logs]
    table = F.broadcast(spark.createDataFrame([(k, f, n) for k, (f, n) in enumerate(zip(factors, near, strict=True))], "s int, scale double, near double"))
    ends = score_rows.groupBy("pair_id").agg(F.min("score").alias("_a"), F.max("score").alias("_b"))
    w = min(max(weight, 0.0), 0.99)
    rows = score_rows.join(ends, "pair_id").join(table, "s")
    span = F.col("_b") - F.col("_a")
    scaled = F.when(span > 0, (F.col("score") - F.col("_a")) / span).otherwise(F.coalesce("score", F.lit(0.0)))
    blended = rows.withColumn("blend", F.round(scaled * (1 - w) + F.col("near") * w, 12)).where("blend IS NOT NULL")
    top = F.max_by(F.struct("s", "t", "shift", "scale"), F.struct("blend", -F.col("s"), -F.col("t"))).alias("x")
    return blended.groupBy("pair_id").agg(top).select("pair_id", "x.*")


@dataclass(frozen=True)
class SliceSearch:
    """The search along one axis, for all pairs of two tables of voxels(pair_id, d, h, w, feat[, msk])."""

    scale_range: tuple[float, float] = (0.95, 1.05)
    n_scales: int = 101
    reach: float = 0.3
    weight: float = 0.05
    blend: bool = True
    min_overlap: float = 0.5
    smooth_matrix: float = 1.0
    smooth_scores: float = 1.0
    start: float = 0.1
    end: float = 0.1

    def _chosen(self, voxels: DataFrame, axis: str) -> tuple[DataFrame, DataFrame]:
        vectors = slice_vectors(voxels, axis)
        indexes = voxels.select("pair_id", F.col(PLANES[axis][0]).alias("idx")).distinct()
        own = cosine_matrix(vectors, vectors, indexes, indexes)
        return vectors, chosen_range(distinct_slices(own), self.start, self.end)

    def axis(self, fixed: DataFrame, moving: DataFrame, axis: str) -> DataFrame:
        """pair_id, scale, shift."""
        fv, fr = self._chosen(fixed, axis)
        mv, mr = self._chosen(moving, axis)
        cut = lambda v, r: v.join(r.select("pair_id", "first", "last"), "pair_id").where("idx >= first AND idx < last").withColumn("idx", F.col("idx") - F.col("first")).drop("first", "last")
        every = lambda r: r.select("pair_id", F.explode(F.expr("sequence(0, last - first - 1)")).alias("idx"))
        # small tables that several later steps read
        fr, mr = written(fr, "slices"), written(mr, "slices")
        matrix = written(cosine_matrix(cut(fv, fr), cut(mv, mr), every(fr), every(mr)), "slice-matrix")
        matrix = written(reweighted(written(smoothed(matrix, self.smooth_matrix), "slice-matrix"), self.blend), "slice-matrix")
        both = fr.select("pair_id", F.col("first").alias("f0"), F.col("n").alias("fn")).join(mr.select("pair_id", F.col("first").alias("m0"), F.col("n").alias("mn")), "pair_id")
        both = both.withColumns({"add": F.col("m0") - F.col("f0"), "half": F.greatest(F.floor(F.least("fn", "mn") * self.reach).cast("int"), F.lit(1))})
        shifts = both.select("pair_id", F.posexplode(F.expr("sequence(-half - add, half - add)")).alias("t", "shift"))
        factors = scales(*self.scale_range, self.n_scales)
        table = written(scores(matrix, factors, shifts, self.min_overlap), "slice-scores")
        table = written(smoothed(table, self.smooth_scores, "s", "t", "score"), "slice-scores")
        found = best(table, factors, self.weight).join(both, "pair_id")
        shift = F.rint(F.col("f0") * (1.0 - F.col("scale")) + F.col("shift") + F.col("add"))
        return found.select("pair_id", "scale", shift.alias("shift"))

    def affine(self, fixed: DataFrame, moving: DataFrame, axes: str = "xyz") -> DataFrame:
        """pair_id and a scale and shift for each axis: sd, sh, sw, td, th, tw (1 and 0 for axes left out)."""
        out = fixed.select("pair_id").distinct()
        for axis in "xyz":
            c = PLANES[axis][0]
            if axis in axes:
                out = out.join(self.axis(fixed, moving, axis).select("pair_id", F.col("scale").alias(f"s{c}"), F.col("shift").alias(f"t{c}")), "pair_id")
            else:
                out = out.withColumns({f"s{c}": F.lit(1.0), f"t{c}": F.lit(0.0)})
        return out


def dense(affine: DataFrame, sizes: DataFrame) -> DataFrame:
    """The field of affine(pair_id, sd, ..., tw) on every voxel of sizes(pair_id, nd, nh, nw)."""
    from voxlake.operators.grids import XYZ, full

    grid = full(sizes, ("pair_id",)).join(affine, "pair_id")
    return grid.select("pair_id", *XYZ, *[((F.col(f"s{c}") - 1) * F.col(c) + F.col(f"t{c}")).alias(f"u{c}") for c in XYZ])


def clamped(affine: DataFrame, sizes: DataFrame, scale_range: tuple[float, float], reach: float) -> DataFrame:
    """affine(pair_id, sd, ..., tw) with scales within their range and shifts within a share of the volume's size."""
    rows = affine.join(sizes, "pair_id")
    scales_ = {f"s{c}": V.clamp(F.col(f"s{c}"), *map(float, scale_range)) for c in "dhw"}
    shifts = {f"t{c}": V.clamp(F.col(f"t{c}"), -reach * F.col(f"n{c}"), reach * F.col(f"n{c}")) for c in "dhw"}
    return rows.withColumns(scales_ | shifts).select(*affine.columns)


def refined(search: SliceSearch, fixed: DataFrame, moving: DataFrame, order: str = "zxy", rounds: int = 1, joint: bool = False, limits: tuple[float, float] | None = None) -> DataFrame:
    """Axis by axis, each on features warped by what is known so far; scales and shifts compose in closed form. joint: all axes
    of a round are searched on the same features and composed at its end. limits: the scales' range that compositions are
    kept in, shifts in the search's reach. Every step's affine is a written table of one row for each pair."""
    from voxlake.operators.grids import XYZ, shapes
    from voxlake.operators.warp import trilinear_features

    sizes = written(shapes(moving, ["pair_id"]), "sizes")
    known = fixed.select("pair_id").distinct().withColumns({f"s{c}": F.lit(1.0) for c in XYZ} | {f"t{c}": F.lit(0.0) for c in XYZ})

    def after(known: DataFrame, step: DataFrame, c: str) -> DataFrame:
        both = known.join(step.select("pair_id", F.col("scale").alias("_s"), F.col("shift").alias("_t")), "pair_id")
        new = {f"s{c}": F.col(f"s{c}") * F.col("_s"), f"t{c}": F.col(f"s{c}") * F.col("_t") + F.col(f"t{c}")}
        return both.withColumns(new).drop("_s", "_t")

    for _ in range(rounds):
        for axes in [order] if joint else order:
            moved = written(trilinear_features(dense(known, sizes), moving, sizes), "moved")
            now = known
            for axis in axes:
                now = after(now, search.axis(fixed, moved, axis), PLANES[axis][0])
            now = written(clamped(now, sizes, limits, search.reach) if limits else now, "affine")
            dropped(moved)
            known = now
    return known
