"""Slices of volumes along an axis: order, choice of slices, end marks, and interpolation back to full depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.functions import vectors as V
from voxlake.operators.numbering import ordered

#: For each slicing axis the coordinates that become slice index, row and column.
PLANES = {"x": ("d", "h", "w"), "y": ("h", "d", "w"), "z": ("w", "d", "h")}


def serialize(voxels: DataFrame, dim: str) -> DataFrame:
    """Voxels with slice_idx, row and col along an axis, and is_end on the last slice of an entity."""
    index, row, col = PLANES[dim]
    size = voxels.groupBy("vid").agg(F.max(index).alias("_last"))
    rows = voxels.join(size, "vid")
    named = [F.lit(dim).alias("dim"), F.col(index).alias("slice_idx"), F.col(row).alias("row"), F.col(col).alias("col"), (F.col(index) == F.col("_last")).alias("is_end")]
    return rows.select(*[c for c in voxels.columns if c not in "dhw"], *named)


def canonical(slices: DataFrame, dim: str) -> DataFrame:
    """Back to d, h, w."""
    index, row, col = PLANES[dim]
    return slices.withColumnsRenamed({"slice_idx": index, "row": row, "col": col}).drop("dim", "is_end")


def codes_by_appearance(entities: DataFrame) -> DataFrame:
    """modality, code: codes from 0 in the order of the modality's first entity(pos, modality)."""
    first = entities.groupBy("modality").agg(F.min("pos").alias("_first"))
    return first.select("modality", (F.row_number().over(Window.orderBy("_first")) - 1).alias("code"))


def codes_by_name(entities: DataFrame) -> DataFrame:
    """The registry built when fitting: codes from 0 in the order of names."""
    names = entities.select(F.upper("modality").alias("modality")).distinct()
    return names.select("modality", (F.row_number().over(Window.orderBy("modality")) - 1).alias("code"))


def with_codes(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows with their modality's code; a modality that the registry lacks is an error."""
    known = rows.join(F.broadcast(registry.withColumnRenamed("code", "mod_code")), "modality", "left")
    missing = F.raise_error(F.concat(F.lit("modality without a code: "), F.coalesce("modality", F.lit("null"))))
    return known.withColumn("mod_code", F.when(F.col("mod_code").isNull(), missing).otherwise(F.col("mod_code")))


def by_modality(entities: DataFrame) -> DataFrame:
    """Entities in stable order of (code, position), with their new place and where their slices start."""
    return ordered(entities, ["mod_code", "pos"], "place", {"ent_ptr": F.col("n_slices")})


def restored(rows: DataFrame, order: DataFrame) -> DataFrame:
    """rows with a place of the serialized order, at the positions that the entities had before: order has place and pos."""
    return rows.join(order.select("place", "pos"), "place").drop("place")


def interior(size: Column, every: int) -> Column:
    """Indexes of the slices to keep out of `size`: both ends, and between them one of `every`, centred, the first rounded
    half to even."""
    inner = size - 2
    steps = F.floor((inner - 1) / every)
    spread = steps * every
    start = F.rint((F.lit(1) + (size - 2)) / 2.0 - spread / 2.0)
    start = F.when(start < 1, F.lit(1)).when(start + spread > size - 2, size - 2 - spread).otherwise(start).cast("int")
    middle = F.transform(F.sequence(F.lit(0), F.greatest(steps, F.lit(0)).cast("int")), lambda i: start + i * every)
    full = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), middle, F.array((size - 1).cast("int")))))
    return F.when(size <= 1, F.array(F.lit(0))).when(inner < 1, F.array(F.lit(0), F.lit(1))).otherwise(full)


def subsample(slices: DataFrame, every: int) -> DataFrame:
    """The chosen slices of each entity, by a semi-join with the short list of indexes; the end mark stays on the last."""
    sizes = slices.groupBy("vid").agg((F.max("slice_idx") + 1).alias("n"))
    keep = sizes.select("vid", F.explode(interior(F.col("n"), every)).alias("slice_idx"), (F.col("n") - 1).alias("_last"))
    return slices.drop("is_end").join(keep, ["vid", "slice_idx"]).withColumn("is_end", F.col("slice_idx") == F.col("_last")).drop("_last")


def chosen(slices: DataFrame) -> DataFrame:
    """vid, indexes (ascending) and full depth, known from the end mark."""
    return slices.groupBy("vid").agg(F.array_sort(F.collect_set("slice_idx")).alias("indexes"), (F.max(F.when(F.col("is_end"), F.col("slice_idx"))) + 1).alias("depth"))


def interpolate(kept: DataFrame, depths: DataFrame, keys: list[str]) -> DataFrame:
    """kept(keys, slice_idx, feat) filled to every slice of depths(keys, depth): linear between the slice before and the one
    after, the nearest beyond the ends, and constant where one slice is kept. Windows run within one line of a volume."""
    every = depths.select(*keys, F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("slice_idx"))
    rows = every.join(kept.select(*keys, "slice_idx", "feat"), [*keys, "slice_idx"], "left")
    line = Window.partitionBy(*keys).orderBy("slice_idx")
    at = F.when(F.col("feat").isNotNull(), F.struct(F.col("slice_idx").alias("i"), F.col("feat").alias("f")))
    rows = rows.select(
        *keys,
        "slice_idx",
        F.last(at, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("a"),
        F.first(at, ignorenulls=True).over(line.rowsBetween(0, Window.unboundedFollowing)).alias("b"),
    )
    share = (F.col("slice_idx") - F.col("a.i")) / (F.col("b.i") - F.col("a.i"))
    feat = F.when(F.col("a").isNull(), F.col("b.f")).when(F.col("b").isNull() | (F.col("a.i") == F.col("b.i")), F.col("a.f")).otherwise(V.lerp(F.col("a.f"), F.col("b.f"), share))
    return rows.select(*keys, "slice_idx", feat.alias("feat"))


def background(slices: DataFrame) -> DataFrame:
    """vid, bg: the lower median of the four corner pixels of an entity's first and last slice (eight values, also if equal)."""
    ends = slices.groupBy("vid").agg(*[F.min(c).alias(f"_{c}0") for c in ("slice_idx", "row", "col")], *[F.max(c).alias(f"_{c}1") for c in ("slice_idx", "row", "col")])
    corner = " AND ".join(f"({c} = _{c}0 OR {c} = _{c}1)" for c in ("slice_idx", "row", "col"))
    weight = F.expr(" * ".join(f"IF(_{c}0 = _{c}1, 2, 1)" for c in ("slice_idx", "row", "col")))
    rows = slices.join(ends, "vid").where(corner).select("vid", F.explode(F.array_repeat(F.col("value"), weight)).alias("value"))
    return rows.groupBy("vid").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("bg"))


def background_by_modality(backgrounds: DataFrame) -> DataFrame:
    """modality, bg of backgrounds(vid, modality, bg): the lower median."""
    return backgrounds.groupBy("modality").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY bg)").alias("bg"))
