"""Dense grids: coordinates, pooling, padding, token grids and their way back to pixels. Joins are on coordinates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XYZ = ("d", "h", "w")


def shapes(voxels: DataFrame, keys: Sequence[str] = ("vid",)) -> DataFrame:
    """The size along each axis: keys, nd, nh, nw."""
    return voxels.groupBy(*keys).agg(*[(F.max(c) + 1).alias(f"n{c}") for c in XYZ])


def full(sizes: DataFrame, keys: Sequence[str] = ("vid",)) -> DataFrame:
    """Every coordinate of sizes(keys, nd, nh, nw); made where it is needed, never shuffled to be made."""
    out = sizes.select(*keys, "nd", "nh", "nw", F.explode(F.expr("sequence(0, nd - 1)")).alias("d"))
    out = out.select("*", F.explode(F.expr("sequence(0, nh - 1)")).alias("h"))
    return out.select(*keys, "nd", "nh", "nw", "d", "h", F.explode(F.expr("sequence(0, nw - 1)")).alias("w"))


def holes(voxels: DataFrame, keys: Sequence[str] = ("vid",)) -> DataFrame:
    """keys, d, h, w of the coordinates within volumes that have no voxel. Planes are counted first, and voxels are asked for in
    those alone that aren't whole."""
    planes = voxels.groupBy(*keys, "d").agg(F.count(F.lit(1)).alias("_n"), F.max("h").alias("h"), F.max("w").alias("w"))
    every = shapes(planes, keys).select("*", F.explode(F.expr("sequence(0, nd - 1)")).alias("d"))
    lacking = every.join(planes.select(*keys, "d", "_n"), [*keys, "d"], "left").where("coalesce(_n, 0) < nh * nw").drop("_n")
    cells = lacking.select(*keys, "d", "nw", F.explode(F.expr("sequence(0, nh - 1)")).alias("h")).select(*keys, "d", "h", F.explode(F.expr("sequence(0, nw - 1)")).alias("w"))
    there = voxels.select(*keys, *XYZ).join(lacking.select(*keys, "d"), [*keys, "d"], "left_semi")
    return cells.join(there, [*keys, *XYZ], "left_anti").select(*keys, *XYZ)


def filled(voxels: DataFrame, values: dict[str, Column], keys: Sequence[str] = ("vid",), lacking: DataFrame | None = None) -> DataFrame:
    """voxels and their holes, which have these values (other columns null), and `_there`, which tells them apart."""
    lacking = holes(voxels, keys) if lacking is None else lacking
    return voxels.withColumn("_there", F.lit(True)).unionByName(lacking.select(*keys, *XYZ, *[x.alias(v) for v, x in values.items()], F.lit(False).alias("_there")), allowMissingColumns=True)


def normalised(at: Column, size: Column) -> Column:
    """A voxel coordinate on [-1, 1]; 0 on an axis of one voxel."""
    return F.when(size > 1, 2.0 * at / (size - 1) - 1.0).otherwise(0.0)


def scatter(tokens: DataFrame, sizes: DataFrame, keys: Sequence[str] = ("vid",)) -> DataFrame:
    """tokens(keys, d, h, w, value) on the whole grid: 0 where there is none, and whether there was one."""
    found = full(sizes, keys).drop("nd", "nh", "nw").join(tokens.select(*keys, *XYZ, "value"), [*keys, *XYZ], "left")
    return found.select(*keys, *XYZ, F.coalesce("value", F.lit(0.0)).alias("value"), F.col("value").isNotNull().alias("present"))


def pooled(voxels: DataFrame, k: int, value: str = "value", keys: Sequence[str] = ("vid",)) -> DataFrame:
    """Means of k x k x k cells; an incomplete cell at the far end is dropped. Sums are combined before the shuffle."""
    sizes = shapes(voxels, keys)
    rows = voxels.join(sizes, [*keys]).where(" AND ".join(f"{c} < {k} * (n{c} div {k})" for c in XYZ))
    cell = [F.expr(f"cast({c} div {k} as int)").alias(c) for c in XYZ]
    return rows.groupBy(*keys, *cell).agg(F.avg(value).alias(value))


def _partial_sums(width: int):
    """Rows of `width` key columns and a vector -> for each key of a batch the sum of its vectors and how many they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.stack([c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for c in batch.columns[:width]], 1)
            _, first, place = np.unique(codes, axis=0, return_index=True, return_inverse=True)
            place = place.ravel()
            order = np.argsort(place, kind="stable")
            x = batch.column(width).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            counts = np.bincount(place)
            sums = np.add.reduceat(x[order], np.cumsum(counts) - counts, 0)
            ends = pa.array(np.arange(0, sums.size + 1, sums.shape[1]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(first)) for c in batch.columns[:width]), pa.ListArray.from_arrays(ends, pa.array(sums.ravel())), pa.array(counts)], [*batch.schema.names[:width], "total", "n"])

    return run


def pooled_features(voxels: DataFrame, k: int, keys: Sequence[str] = ("vid",)) -> DataFrame:
    """The same for vectors in feat: tasks add up their own rows' vectors first, so no channel is a row."""
    sizes = shapes(voxels, keys)
    rows = voxels.join(sizes, [*keys]).where(" AND ".join(f"{c} < {k} * (n{c} div {k})" for c in XYZ))
    cell = [F.expr(f"cast({c} div {k} as int)").alias(c) for c in XYZ]
    rows = rows.select(*keys, *cell, F.col("feat").cast("array<double>").alias("feat"))
    kinds = dict(rows.dtypes)
    shape = ", ".join([*(f"`{k}` {kinds[k]}" for k in [*keys, *XYZ]), "total array<double>", "n long"])
    parts = rows.mapInArrow(_partial_sums(len(keys) + 3), shape).groupBy(*keys, *XYZ).agg(F.collect_list("total").alias("_t"), F.sum("n").alias("_n"))  # k^3 of a cell at most
    added = F.aggregate(F.slice("_t", 2, k**3), F.element_at("_t", 1), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    return parts.select(*keys, *XYZ, F.transform(added, lambda x: x / F.col("_n")).alias("feat"))


def pooled_field(field: DataFrame, k: int, keys: Sequence[str] = ("pair_id",)) -> DataFrame:
    """A displacement field in a grid k times coarser: its values shrink by k, too."""
    sizes = shapes(field, keys)
    rows = field.join(sizes, [*keys]).where(" AND ".join(f"{c} < {k} * (n{c} div {k})" for c in XYZ))
    cell = [F.expr(f"cast({c} div {k} as int)").alias(c) for c in XYZ]
    return rows.groupBy(*keys, *cell).agg(*[F.avg(F.col(f"u{c}") / k).alias(f"u{c}") for c in XYZ])


def pooled_mask(mask: DataFrame, k: int, threshold: float = 0.1, keys: Sequence[str] = ("vid",)) -> DataFrame:
    """Cells whose share of masked voxels exceeds a threshold: keys, d, h, w, msk."""
    rows = mask.withColumn("value", F.coalesce(F.col("msk"), F.lit(False)).cast("double"))
    return pooled(rows, k, "value", keys).select(*keys, *XYZ, (F.col("value") > threshold).alias("msk"))


def padding(size: Column, stride: int) -> tuple[Column, Column]:
    """What a side needs to reach a multiple of stride: before (the larger half) and after."""
    need = F.ceil(size / stride) * stride - size
    after = F.floor(need / 2)
    return (need - after).cast("int"), after.cast("int")


def padded(voxels: DataFrame, before: Sequence[int], after: Sequence[int], value: float | None = None, column: str = "value", keys: Sequence[str] = ("vid",)) -> DataFrame:
    """keys, d, h, w and the column of volumes padded along each axis: with a value, or (None) with their border's."""
    sizes = shapes(voxels, keys)
    wide = sizes.select(*keys, *[(F.col(f"n{c}") + int(a) + int(b)).alias(f"n{c}") for c, a, b in zip(XYZ, before, after, strict=True)])
    grid = full(wide, keys).drop("nd", "nh", "nw").join(sizes, [*keys])
    at = {f"_{c}": F.col(c) - int(a) for c, a in zip(XYZ, before, strict=True)}
    if value is None:
        at = {f"_{c}": F.greatest(F.least(at[f"_{c}"], F.col(f"n{c}") - 1), F.lit(0)) for c in XYZ}
    source = voxels.select(*keys, *[F.col(c).alias(f"_{c}") for c in XYZ], column)
    met = grid.withColumns(at).join(source, [*keys, *[f"_{c}" for c in XYZ]], "left")
    return met.select(*keys, *XYZ, (F.coalesce(column, F.lit(value)) if value is not None else F.col(column)).alias(column))


def zoomed(voxels: DataFrame, factors: Sequence[float], column: str = "value", order: int = 1, keys: Sequence[str] = ("vid",), partial: bool = False) -> DataFrame:
    """Volumes with round(n * factor) voxels along each axis; corners meet corners. order 3: cubic splines; 1: linear; 0: the nearest
    voxel, for labels and masks. partial: splines of volumes that lack voxels."""
    if order == 3:
        from voxlake.operators import splines

        return splines.zoomed(voxels, factors, column, keys, partial)
    if order not in (0, 1):
        raise ValueError(f"order must be 0, 1 or 3, not {order}")
    sizes = shapes(voxels, keys)
    new = sizes.select(*keys, *[F.greatest(F.rint(F.col(f"n{c}") * float(f)).cast("int"), F.lit(1)).alias(f"n{c}") for c, f in zip(XYZ, factors, strict=True)])
    old = sizes.select(*keys, *[F.col(f"n{c}").alias(f"_n{c}") for c in XYZ])
    rows = full(new, keys).join(old, [*keys])
    for c in XYZ:
        at = F.when(F.col(f"n{c}") > 1, F.col(c) * (F.col(f"_n{c}") - 1) / (F.col(f"n{c}") - 1)).otherwise(F.lit(0.0))
        if order == 0:
            rows = rows.withColumns({f"_{c}": F.floor(at + 0.5).cast("int"), f"_w{c}": F.lit(1.0)})
            continue
        low = F.least(F.floor(at), F.greatest(F.col(f"_n{c}") - 2, F.lit(0)))
        pair = F.filter(F.array(F.struct(low.cast("int").alias("s"), (1 - (at - low)).alias("k")), F.struct((low + 1).cast("int").alias("s"), (at - low).alias("k"))), lambda p: p["k"] > 0)
        rows = rows.withColumn("_t", F.explode(pair)).withColumns({f"_{c}": F.col("_t.s"), f"_w{c}": F.col("_t.k")}).drop("_t")
    source = voxels.select(*keys, *[F.col(c).alias(f"_{c}") for c in XYZ], column)
    met = rows.join(source, [*keys, *[f"_{c}" for c in XYZ]])
    if order == 0:
        return met.select(*keys, *XYZ, column)
    return met.groupBy(*keys, *XYZ).agg(F.sum(F.col(column) * F.col("_wd") * F.col("_wh") * F.col("_ww")).alias(column))


def pad_slices(slices: DataFrame, stride: int, backgrounds: DataFrame) -> DataFrame:
    """slices(vid, slice_idx, row, col, value) padded to multiples of stride with each entity's background(vid, bg)."""
    sizes = slices.groupBy("vid").agg((F.max("slice_idx") + 1).alias("n"), (F.max("row") + 1).alias("nr"), (F.max("col") + 1).alias("nc"))
    (top, bottom), (left, right) = padding(F.col("nr"), stride), padding(F.col("nc"), stride)
    sizes = sizes.select("vid", "n", "nr", "nc", top.alias("top"), bottom.alias("bottom"), left.alias("left"), right.alias("right")).join(backgrounds, "vid")
    grid = sizes.select("vid", "bg", "top", "left", "nr", "nc", F.expr("top + nr + bottom").alias("_r"), F.expr("left + nc + right").alias("_c"), F.explode(F.expr("sequence(0, n - 1)")).alias("slice_idx"))
    grid = grid.select("*", F.explode(F.expr("sequence(0, _r - 1)")).alias("prow"))
    grid = grid.select("*", F.explode(F.expr("sequence(0, _c - 1)")).alias("pcol"))
    grid = grid.withColumns({"row": F.col("prow") - F.col("top"), "col": F.col("pcol") - F.col("left")})
    found = grid.join(slices.select("vid", "slice_idx", "row", "col", "value"), ["vid", "slice_idx", "row", "col"], "left")
    return found.select("vid", "slice_idx", F.col("prow").alias("row"), F.col("pcol").alias("col"), F.coalesce("value", "bg").alias("value"))


def token_grid(rows: Column, cols: Column, patch: int, fixed: tuple[int, int] | None = None) -> Column:
    """struct(gh, gw): a model's fixed grid, or one token for each patch."""
    gh, gw = (F.lit(fixed[0]), F.lit(fixed[1])) if fixed else (F.floor(rows / patch).cast("int"), F.floor(cols / patch).cast("int"))
    return F.struct(gh.alias("gh"), gw.alias("gw"))


def patch_mask(slices: DataFrame, patch: int, threshold: float | None = 0.1) -> DataFrame:
    """vid, slice_idx, tok_y, tok_x, msk: patches whose share of masked pixels exceeds a threshold; None: any pixel."""
    inside = F.coalesce(F.col("msk"), F.lit(False)).cast("double")
    share = F.max(inside) > 0.5 if threshold is None else F.avg(inside) > threshold
    return slices.groupBy("vid", "slice_idx", F.expr(f"cast(row div {patch} as int)").alias("tok_y"), F.expr(f"cast(col div {patch} as int)").alias("tok_x")).agg(share.alias("msk"))


def unpatch(tokens: DataFrame, patch: int, top: int, left: int, rows: int, cols: int) -> DataFrame:
    """tokens(vid, slice_idx, tok_y, tok_x, feat) laid over their pixels, without the padding: row, col."""
    inside = f"row BETWEEN 0 AND {rows - 1} AND col BETWEEN 0 AND {cols - 1}"
    out = tokens.select("vid", "slice_idx", "tok_x", "feat", F.explode(F.expr(f"sequence(tok_y * {patch} - {top}, tok_y * {patch} - {top} + {patch - 1})")).alias("row"))
    out = out.select("vid", "slice_idx", "row", "feat", F.explode(F.expr(f"sequence(tok_x * {patch} - {left}, tok_x * {patch} - {left} + {patch - 1})")).alias("col"))
    return out.where(inside).select("vid", "slice_idx", "row", "col", "feat")


def resized(pixels: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """pixels(vid, slice_idx, row, col, value) from (rows[0], cols[0]) to (rows[1], cols[1]), bilinear with half-pixel centres.
    A target pixel joins its four sources, which carry their weights."""
    spark = pixels.sparkSession

    def taps(name: str, old: int, new: int) -> DataFrame:
        at = F.greatest((F.col(name) + 0.5) * (old / new) - 0.5, F.lit(0.0))
        low = F.least(F.floor(at), F.lit(old - 1)).cast("int")
        base = spark.range(new).select(F.col("id").cast("int").alias(name)).select(name, low.alias("a"), (at - F.floor(at)).alias("t"))
        pair = F.array(F.struct(F.col("a").alias("s"), (1 - F.col("t")).alias("w")), F.struct(F.least(F.col("a") + 1, F.lit(old - 1)).alias("s"), F.col("t").alias("w")))
        return base.select(name, F.explode(pair).alias("x")).select(name, F.col("x.s").alias(f"_{name}"), F.col("x.w").alias(f"_w{name}"))

    r, c = taps("row", *rows), taps("col", *cols)
    source = pixels.withColumnsRenamed({"row": "_row", "col": "_col"})
    met = source.join(F.broadcast(r), "_row").join(F.broadcast(c), "_col")
    return met.groupBy("vid", "slice_idx", "row", "col").agg(F.sum(F.col("value") * F.col("_wrow") * F.col("_wcol")).alias("value"))
