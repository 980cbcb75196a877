"""Masks of a batch: attached for fits, generated where a collection has none, and routed to the stages that read them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.functions import grammar
from voxlake.operators import features
from voxlake.operators.grids import XYZ


def attached(voxels: DataFrame, generated: DataFrame, mode: str) -> DataFrame:
    """voxels(vid, d, h, w, ..., msk) with msk_raw (as it came), msk_gen (of generated(vid, d, h, w, msk); null where there is
    none) and msk: what a fit reads in a mode of `features.fit_mask`."""
    at = ["vid", *XYZ]
    found = generated.select(*at, F.col("msk").alias("msk_gen"))
    rows = voxels.join(found, at, "left").withColumn("msk_raw", F.col("msk"))
    return features.fit_mask(rows, mode).withColumn("msk", F.col("msk_fit")).drop("msk_fit")


def injected(voxels: DataFrame, generated: DataFrame) -> DataFrame:
    """voxels with generated masks. A collection that has masks of its own is an error where it is read: two sources of
    masks would be mixed."""
    at = ["vid", *XYZ]
    own = F.when(F.col("msk").isNotNull(), F.raise_error(F.concat(F.lit("the collection has a mask of its own: "), F.col("vid")))).otherwise(F.col("_gen"))
    rows = voxels.join(generated.select(*at, F.col("msk").alias("_gen")), at, "left")
    return rows.withColumn("msk", own.cast("boolean")).drop("_gen")


def routed(mode: str, extractor: str = "descriptor") -> dict[str, bool]:
    """Which stages read masks in a mode such as `feat+affine`: feat, affine, elastic. Encoders of whole slices have no masked
    form, so `feat` is refused for them."""
    parts = set(grammar.mask_mode(mode).split("+"))
    if extractor == "encoder" and "feat" in parts:
        raise ValueError("an encoder of whole slices reads no mask; leave `feat` out of the mode")
    return {stage: stage in parts for stage in ("feat", "affine", "elastic")}


def stage_rows(voxels: DataFrame, mode: str, stage: str, extractor: str = "descriptor") -> DataFrame:
    """voxels as a stage sees them: msk is null where the mode doesn't send it there."""
    return voxels if routed(mode, extractor)[stage] else voxels.withColumn("msk", F.lit(None).cast("boolean"))


def flat(masks: DataFrame, column: str = "msk") -> DataFrame:
    """masks with a column of nested arrays (N x H x W, N x 1 x H x W or N x HW) as one row for each slice: slice_idx and a flat
    array of booleans; other numbers count as true above 0."""
    kind = masks.schema[column].dataType.simpleString()
    depth = kind.count("array<")
    if depth < 2:
        raise ValueError(f"a mask of slices has at least two dimensions, not {kind}")
    one = F.col("_slice")
    for _ in range(depth - 2):
        one = F.flatten(one)
    kept = one if kind.strip(">").endswith("boolean") else F.transform(one, lambda x: x > 0)
    others = [c for c in masks.columns if c != column]
    return masks.select(*others, F.posexplode(column).alias("slice_idx", "_slice")).select(*others, "slice_idx", kept.alias(column))


def items(pointers: DataFrame, entities: DataFrame) -> DataFrame:
    """entities(entity_pos, ...) with the item that each belongs to, of pointers(item, item_ptr, n): a batch split again."""
    of = pointers.select("item", F.explode(F.sequence(F.col("item_ptr"), F.col("item_ptr") + F.col("n") - 1)).alias("entity_pos"))
    return entities.join(of, "entity_pos")


def traced(rows: DataFrame, step: str, **parameters) -> DataFrame:
    """rows with `trace`, an array of (step, parameters), grown by one step."""
    own = F.struct(F.lit(step).alias("step"), F.to_json(F.create_map(*[F.lit(str(x)) for kv in sorted(parameters.items()) for x in kv])).alias("parameters") if parameters else F.lit("{}").alias("parameters"))
    before = F.col("trace") if "trace" in rows.columns else F.array().cast("array<struct<step:string,parameters:string>>")
    return rows.withColumn("trace", F.array_append(before, own))


def summary(trace) -> F.Column:
    """What a trace says in one line."""
    named = lambda text: F.array_join(F.transform(F.map_entries(F.from_json(text, "map<string,string>")), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return F.array_join(F.transform(trace, lambda s: F.concat(s["step"], F.lit("("), named(s["parameters"]), F.lit(")"))), " > ")


def chained(first, second) -> F.Column:
    """The trace of a displacement and then another."""
    return F.concat(first, second)


def subset(text: str, name: str) -> Sequence[int]:
    """The sample numbers of a named subset in a JSON text: name -> list."""
    import json

    every = json.loads(text)
    if name not in every:
        raise ValueError(f"no subset {name!r}; there are {sorted(every)}")
    return [int(x) for x in every[name]]
