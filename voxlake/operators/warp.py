"""Displacements and warping as joins on coordinates.

A field is a table (pair_id, d, h, w, ud, uh, uw); a volume is (pair_id, d, h, w, value). A target voxel computes its
source coordinates and joins them; trilinear sampling joins eight corners, each with its weight.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.functions import vectors as V
from voxlake.operators.grids import XYZ, full


@dataclass(frozen=True)
class Affine:
    """x goes to scale * x + shift on each axis."""

    scale: tuple[float, float, float] = (1.0, 1.0, 1.0)
    shift: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def matrix(self) -> list[list[float]]:
        return [[*(s if i == j else 0.0 for j in range(3)), t] for i, (s, t) in enumerate(zip(self.scale, self.shift, strict=True))] + [[0.0, 0.0, 0.0, 1.0]]

    @classmethod
    def from_matrix(cls, m: list[list[float]]) -> Affine:
        if any(abs(m[i][j]) > 1e-12 for i in range(3) for j in range(3) if i != j):
            raise ValueError("only scale and shift are allowed")
        return cls(tuple(m[i][i] for i in range(3)), tuple(m[i][3] for i in range(3)))

    def after(self, first: Affine) -> Affine:
        """The displacement of `first`, then this one: u(x) = u1(x) + u2(x + u1(x))."""
        scale = tuple(a * b for a, b in zip(self.scale, first.scale, strict=True))
        shift = tuple(a * t + u for a, t, u in zip(self.scale, first.shift, self.shift, strict=True))
        return Affine(scale, shift)

    def columns(self) -> dict[str, Column]:
        return {f"u{c}": (s - 1) * F.col(c) + t for c, s, t in zip(XYZ, self.scale, self.shift, strict=True)}

    def dense(self, sizes: DataFrame, keys: tuple[str, ...] = ("pair_id",)) -> DataFrame:
        """Its field on every voxel of sizes(keys, nd, nh, nw)."""
        return self.on(full(sizes, keys), keys)

    def on(self, voxels: DataFrame, keys: tuple[str, ...] = ("pair_id",)) -> DataFrame:
        """Its field on voxels(keys, d, h, w)."""
        return voxels.select(*keys, *XYZ, *[u.cast("double").alias(n) for n, u in self.columns().items()])


def matrices(scale: Column, shift: Column) -> Column:
    """4 x 4 matrices of the affines with these scales and shifts (arrays of three)."""
    row = lambda i: F.array(*[F.get(scale, F.lit(i)) if i == j else F.lit(0.0) for j in range(3)], F.get(shift, F.lit(i)))
    return F.array(*[row(i) for i in range(3)], F.array(*[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)]))


def affines(matrix: Column) -> Column:
    """struct(scale, shift) of 4 x 4 matrices; one that does more than scale and shift is an error."""
    cell = lambda i, j: F.get(F.get(matrix, F.lit(i)), F.lit(j))
    turned = F.exists(F.array(*[cell(i, j) for i in range(3) for j in range(3) if i != j]), lambda x: F.abs(x) > 1e-12)
    wrong = F.raise_error(F.lit("only scale and shift are allowed")).cast("double")
    own = lambda i, j: F.when(turned, wrong).otherwise(cell(i, j)) if i == 0 else cell(i, j)
    return F.struct(F.array(*[own(i, i) for i in range(3)]).alias("scale"), F.array(*[own(i, 3) for i in range(3)]).alias("shift"))


def rescaled(affine: Column, factors: tuple[float, float, float]) -> Column:
    """A 4 x 4 voxel-to-world matrix after zooming by factors: axis vectors are divided."""
    by = F.array(*[F.lit(float(f)) for f in (*factors, 1.0)])
    return F.transform(affine, lambda row: F.zip_with(row, by, lambda x, f: x / f))


def nearest(field: DataFrame, source: DataFrame, sizes: DataFrame, value: str = "value", boundary: str = "clamp") -> DataFrame:
    """pair_id, d, h, w and the source's value at round-half-even(x + u); beyond the volume the border ("clamp") or 0 ("zero")."""
    rows = field.join(sizes, "pair_id")
    target = {f"_{c}": F.rint(F.col(c) + F.col(f"u{c}")) for c in XYZ}
    if boundary == "clamp":
        target = {f"_{c}": V.clamp(target[f"_{c}"], 0, F.col(f"n{c}") - 1) for c in XYZ}
    keyed = rows.select("pair_id", *XYZ, *[t.cast("int").alias(n) for n, t in target.items()])
    found = source.select("pair_id", *[F.col(c).alias(f"_{c}") for c in XYZ], value)
    met = keyed.join(found, ["pair_id", *[f"_{c}" for c in XYZ]], "inner" if boundary == "clamp" else "left")
    kind = dict(source.dtypes)[value]
    return met.select("pair_id", *XYZ, (F.col(value) if boundary == "clamp" else F.coalesce(value, F.lit(0).cast(kind))).alias(value))


def corners(rows: DataFrame, boundary: str = "clamp") -> DataFrame:
    """rows(pair_id, d, h, w, x0, x1, x2, nd, nh, nw) -> one row for each corner with weight: _d, _h, _w, _weight.
    Beyond the volume the border's voxels ("clamp"), or none ("zero")."""
    out = rows
    for c, x in zip(XYZ, ("x0", "x1", "x2"), strict=True):
        at = V.clamp(F.col(x), 0.0, F.col(f"n{c}") - 1) if boundary == "clamp" else F.col(x)
        low = F.floor(at)
        pair = F.array(F.struct(low.cast("int").alias("s"), (1 - (at - low)).alias("k")), F.struct((low + 1).cast("int").alias("s"), (at - low).alias("k")))
        out = out.withColumn(f"_t{c}", F.filter(pair, lambda p: p["k"] > 0))
    for c in XYZ:
        out = out.withColumn(f"_t{c}", F.explode(f"_t{c}"))
    weight = F.col("_td.k") * F.col("_th.k") * F.col("_tw.k")
    return out.select("pair_id", *XYZ, *[F.col(f"_t{c}.s").alias(f"_{c}") for c in XYZ], weight.alias("_weight"))


def _sampled(rows: DataFrame, source: DataFrame, values: list[str], boundary: str) -> DataFrame:
    taps = corners(rows, boundary)
    found = source.select("pair_id", *[F.col(c).alias(f"_{c}") for c in XYZ], *[F.col(v).alias(f"_v{v}") for v in values])
    met = taps.join(found, ["pair_id", *[f"_{c}" for c in XYZ]], "left")
    sums = [F.sum(F.coalesce(F.col(f"_v{v}"), F.lit(0.0)) * F.col("_weight")).alias(v) for v in values]
    return met.groupBy("pair_id", *XYZ).agg(*sums)


def trilinear(field: DataFrame, source: DataFrame, sizes: DataFrame, values: list[str] | None = None, boundary: str = "clamp") -> DataFrame:
    """pair_id, d, h, w and the source's values at x + u; voxels that the source lacks are 0."""
    at = [(F.col(c) + F.col(f"u{c}")).alias(x) for c, x in zip(XYZ, ("x0", "x1", "x2"), strict=True)]
    rows = field.join(sizes, "pair_id").select("pair_id", *XYZ, *at, "nd", "nh", "nw")
    return _sampled(rows, source, values or ["value"], boundary)


def trilinear_features(field: DataFrame, source: DataFrame, sizes: DataFrame) -> DataFrame:
    """The same for vectors in feat, of one length in a pair: channels are summed by place."""
    at = [(F.col(c) + F.col(f"u{c}")).alias(x) for c, x in zip(XYZ, ("x0", "x1", "x2"), strict=True)]
    taps = corners(field.join(sizes, "pair_id").select("pair_id", *XYZ, *at, "nd", "nh", "nw"))
    met = taps.join(source.select("pair_id", *[F.col(c).alias(f"_{c}") for c in XYZ], "feat"), ["pair_id", *[f"_{c}" for c in XYZ]], "left")
    parts = met.groupBy("pair_id", *XYZ).agg(F.collect_list(V.scale(F.col("feat"), F.col("_weight"))).alias("p"))  # eight at most
    first = F.get("p", F.lit(0))
    moved = parts.select("pair_id", *XYZ, F.aggregate(F.slice("p", 2, 8), first, lambda s, v: F.zip_with(s, v, lambda a, b: a + b)).alias("feat"))
    lengths = source.groupBy("pair_id").agg(F.max(F.size("feat")).alias("_c"))
    return moved.join(lengths, "pair_id").select("pair_id", *XYZ, F.coalesce("feat", F.array_repeat(F.lit(0.0), F.col("_c"))).alias("feat"))


def mask(field: DataFrame, source: DataFrame, sizes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """A warped mask: trilinear with 0 beyond the volume, then compared with a threshold."""
    values = source.select("pair_id", *XYZ, F.coalesce(F.col("msk"), F.lit(False)).cast("double").alias("value"))
    return trilinear(field, values, sizes, boundary="zero").select("pair_id", *XYZ, (F.col("value") > threshold).alias("msk"))


def composed(first: DataFrame, second: DataFrame, sizes: DataFrame) -> DataFrame:
    """The field of `first` and then `second`: u1(x) + u2(x + u1(x)), u2 sampled with the border clamped."""
    names = [f"u{c}" for c in XYZ]
    moved = trilinear(first, second, sizes, names)
    both = first.join(moved.select("pair_id", *XYZ, *[F.col(n).alias(f"_{n}") for n in names]), ["pair_id", *XYZ])
    return both.select("pair_id", *XYZ, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in names])


def pair_mask(fixed: DataFrame, moved: DataFrame, mode: str) -> DataFrame:
    """The mask of one level from fixed(pair_id, d, h, w, msk) and the warped moving mask: none, fix, mov, inter or union."""
    both = fixed.select("pair_id", *XYZ, F.col("msk").alias("a")).join(moved.select("pair_id", *XYZ, F.col("msk").alias("b")), ["pair_id", *XYZ])
    masks = {"none": F.lit(True), "fix": F.col("a"), "mov": F.col("b"), "inter": F.col("a") & F.col("b"), "union": F.col("a") | F.col("b")}
    if mode not in masks:
        raise ValueError(f"{mode!r} is none of {[*masks]}")
    return both.select("pair_id", *XYZ, masks[mode].alias("msk"))


def line(rows: DataFrame, scale: float, shift: float, keys: list[str], volume: list[str] | None = None) -> DataFrame:
    """rows(keys, idx, value) resampled along one axis at scale * idx + shift: linear, the ends clamped. volume: keys of what a line is
    part of, where lines may lack voxels: all are as long as the longest; voxels that aren't there are 0, and what reaches none is left out."""
    at = V.clamp(F.lit(float(scale)) * F.col("idx") + F.lit(float(shift)), 0.0, F.col("_n") - 1)
    if volume is None:
        taps = rows.select(*keys, "idx", F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n"))
    else:
        taps = rows.select(*keys, "idx").join(rows.groupBy(*volume).agg((F.max("idx") + 1).alias("_n")), volume)
    taps = taps.withColumn("_at", at)
    pair = F.array(F.struct(F.floor("_at").cast("int").alias("s"), (1 - (F.col("_at") - F.floor("_at"))).alias("k")), F.struct(F.least(F.floor("_at") + 1, F.col("_n") - 1).cast("int").alias("s"), (F.col("_at") - F.floor("_at")).alias("k")))
    taps = taps.select(*keys, "idx", F.explode(F.filter(pair, lambda t: t["k"] > 0)).alias("t")).select(*keys, "idx", F.col("t.s").alias("_s"), F.col("t.k").alias("_k"))
    source = rows.select(*keys, F.col("idx").alias("_s"), F.col("value").alias("_v"))
    return taps.join(source, [*keys, "_s"]).groupBy(*keys, "idx").agg(F.sum(F.col("_v") * F.col("_k")).alias("value"))
