"""Encoders of slices into tokens.

An encoder takes slices(vid, dim, slice_idx, row, col, value) and gives tokens(vid, dim, slice_idx, tok_y, tok_x, feat). Weights of
image models aren't part of this library: `register` takes any function of that form, such as one that runs a model in
mapInPandas over whole slices. The built-in encoder describes each patch by statistics, in aggregates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[DataFrame], DataFrame]
_registry: dict[str, Callable[..., Encoder]] = {}


def register(name: str, make: Callable[..., Encoder]) -> None:
    _registry[name] = make


def get(name: str, **options) -> Encoder:
    if name not in _registry:
        raise ValueError(f"no encoder {name!r}; there are {sorted(_registry)}")
    return _registry[name](**options)


def patch_statistics(patch: int = 2) -> Encoder:
    """Mean, deviation, least and greatest value, and the mean slopes along rows and columns of each patch."""

    def encode(slices: DataFrame) -> DataFrame:
        place = [F.expr(f"cast(row div {patch} as int)").alias("tok_y"), F.expr(f"cast(col div {patch} as int)").alias("tok_x")]
        middle = (patch - 1) / 2
        dy, dx = F.col("row") % patch - middle, F.col("col") % patch - middle
        v = F.col("value")
        stats = [F.avg(v), F.stddev_pop(v), F.min(v), F.max(v), F.avg(v * dy), F.avg(v * dx)]
        found = slices.groupBy("vid", "dim", "slice_idx", *place).agg(*[s.alias(f"_{k}") for k, s in enumerate(stats)])
        return found.select("vid", "dim", "slice_idx", "tok_y", "tok_x", F.array(*[F.col(f"_{k}") for k in range(len(stats))]).alias("feat"))

    return encode


register("patch_statistics", patch_statistics)


def repeated(slices: DataFrame, channels: int = 3) -> DataFrame:
    """slices with `channels`, an array of the gray value for each channel that an encoder expects."""
    return slices.withColumn("channels", F.array_repeat("value", channels))


def resized_for(slices: DataFrame, policy: str, patch: int, backgrounds: DataFrame, fixed: tuple[int, int] | None = None, size: tuple[int, int] | None = None) -> DataFrame:
    """Slices as an encoder takes them. `none`: sides must be whole patches, others are an error where they are read;
    `pad_to_patch`: padded to whole patches; `resize_to_fixed`: all brought from one size (rows, cols) to the fixed one."""
    from voxlake.operators import grids

    if policy == "pad_to_patch":
        return grids.pad_slices(slices, patch, backgrounds)
    if policy == "resize_to_fixed":
        if fixed is None or size is None:
            raise ValueError("resize_to_fixed needs the slices' size and the fixed one")
        return grids.resized(slices, (size[0], fixed[0]), (size[1], fixed[1]))
    if policy != "none":
        raise ValueError(f"{policy!r} is none of none, pad_to_patch, resize_to_fixed")
    sizes = slices.groupBy("vid").agg((F.max("row") + 1).alias("_r"), (F.max("col") + 1).alias("_c"))
    whole = (F.col("_r") % patch == 0) & (F.col("_c") % patch == 0)
    wrong = F.raise_error(F.concat(F.lit(f"sides aren't multiples of {patch}: "), F.col("vid")))
    return slices.join(sizes, "vid").withColumn("value", F.when(whole, F.col("value")).otherwise(wrong)).drop("_r", "_c")


def standardised(slices: DataFrame, mean: float, std: float) -> DataFrame:
    """slices with the values that an encoder expects: less the mean of its training images, divided by their deviation."""
    if std <= 0:
        raise ValueError(f"a deviation must be above 0, not {std}")
    return slices.withColumn("value", (F.col("value") - mean) / std)


def extract(encoder: Encoder, slices: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """The tokens of a plan(vid, slice_idx, tok_y, tok_x); slices that it doesn't name are never encoded."""
    if plan is None:
        return encoder(slices)
    wanted = slices.join(plan.select("vid", "slice_idx").distinct(), ["vid", "slice_idx"], "left_semi")
    return encoder(wanted).join(plan.select("vid", "slice_idx", "tok_y", "tok_x").distinct(), ["vid", "slice_idx", "tok_y", "tok_x"], "left_semi")
