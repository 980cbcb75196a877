"""Intensity normalisation: fitting is an aggregate for each volume or a search for its ranks, applying is an expression after one
small join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.functions import vectors as V
from voxlake.operators.selection import percentiles


def applies(modalities: Sequence[str] | None, modality: Column | str = "modality") -> Column:
    """Whether a stage for these modalities (None: all) takes a row."""
    column = F.col(modality) if isinstance(modality, str) else modality
    return F.lit(True) if modalities is None else F.coalesce(F.upper(column).isin(*[m.upper() for m in modalities]), F.lit(False))


def window(value: Column, low: float, high: float) -> Column:
    """Clipped to [low, high] and laid on [0, 1]."""
    if high <= low:
        raise ValueError(f"a window from {low} to {high} is empty")
    return (V.clamp(value, low, high) - low) / (high - low)


def fixed_mean_std(constants: Mapping[str, tuple[float, float]], value: str = "value", eps: float = 1e-8) -> Column:
    """(x - mean) / (std + eps) with constants for each modality; others stay as they are."""
    out = F.when(F.lit(False), F.col(value))
    for name, (mean, std) in constants.items():
        out = out.when(F.upper("modality") == name.upper(), (F.col(value) - mean) / (std + eps))
    return out.otherwise(F.col(value))


def percentile_bounds(voxels: DataFrame, low: float, high: float, use_mask: bool = True, keys: Sequence[str] = ("vid",)) -> DataFrame:
    """low and high of each volume: exact percentiles (0 to 100, linear between ranks) of the voxels in the mask, or the least
    and greatest value where the mask is empty. Ranks are found by narrowing histograms, in buffers that a volume's size, and the
    number of its distinct values, don't change."""
    inside = F.when(F.coalesce(F.col("msk"), F.lit(True)), F.col("value")) if use_mask else F.col("value")
    names = {k: f"_{k}" for k in keys}
    found = percentiles(voxels.select(*keys, inside.alias("value")), (low / 100, high / 100), keys).withColumnsRenamed(names)
    ends = voxels.groupBy(*keys).agg(F.min("value").alias("least"), F.max("value").alias("most"))
    joined = ends.join(found, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()], "left")
    return joined.select(*keys, F.coalesce("p0", "least").alias("low"), F.coalesce("p1", "most").alias("high"))


def clip_to(voxels: DataFrame, bounds: DataFrame, keys: Sequence[str] = ("vid",), eps: float = 1e-8) -> DataFrame:
    """value clipped to its volume's bounds and laid on [0, 1]; 0 where the bounds are one."""
    span = F.col("high") - F.col("low")
    scaled = F.when(span > eps, (V.clamp(F.col("value"), F.col("low"), F.col("high")) - F.col("low")) / span).otherwise(0.0)
    return voxels.join(bounds, [*keys]).withColumn("value", scaled).drop("low", "high")


def by_modality(voxels: DataFrame, low: float = 0.0, high: float = 97.0, ct: tuple[float, float] = (-150.0, 250.0)) -> DataFrame:
    """MR by percentiles of its own volume, CT by a fixed window, others untouched."""
    bounds = percentile_bounds(voxels.where(applies(("MR",))), low, high)
    joined = voxels.join(bounds, "vid", "left")
    span = F.col("high") - F.col("low")
    mr = F.when(span > 1e-8, (V.clamp(F.col("value"), F.col("low"), F.col("high")) - F.col("low")) / span).otherwise(0.0)
    value = F.when(applies(("MR",)), mr).when(applies(("CT",)), window(F.col("value"), *ct)).otherwise(F.col("value"))
    return joined.withColumn("value", value).drop("low", "high")


def part_of(low: str, high: str, share: Column | float) -> Column:
    """The value at a share of a range; the ends exactly, which rounding could leave out."""
    share = F.lit(share) if isinstance(share, float | int) else share
    return F.when(share == 1, F.col(high)).otherwise(F.col(low) + share * (F.col(high) - F.col(low)))


@dataclass
class ZScore:
    """States (n, total, squares) that merge by addition; only values within a share of the range count."""

    low_share: float = 0.0
    high_share: float = 1.0
    eps: float = 1e-8

    def fit(self, voxels: DataFrame, keys: Sequence[str] = ("vid",)) -> DataFrame:
        inside = voxels.where(F.coalesce(F.col("msk"), F.lit(True)))
        ends = inside.groupBy(*keys).agg(F.min("value").alias("_a"), F.max("value").alias("_b"))
        rows = inside.join(ends, [*keys])
        rows = rows.where(F.col("value").between(part_of("_a", "_b", self.low_share), part_of("_a", "_b", self.high_share)))
        return rows.groupBy(*keys).agg(F.count("value").alias("n"), F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("squares"))

    def merge(self, states: DataFrame, keys: Sequence[str]) -> DataFrame:
        return states.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))

    def moments(self, states: DataFrame, keys: Sequence[str]) -> DataFrame:
        mean = F.col("total") / F.col("n")
        return states.select(*keys, mean.alias("mean"), F.sqrt(F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"))

    def apply(self, voxels: DataFrame, states: DataFrame, keys: Sequence[str] = ("vid",)) -> DataFrame:
        joined = voxels.join(self.moments(states, keys), [*keys])
        return joined.withColumn("value", (F.col("value") - F.col("mean")) / (F.col("std") + self.eps)).drop("mean", "std")


def merged_bounds(bounds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One pair of bounds from many: the medians."""
    return bounds.groupBy(*keys).agg(F.median("low").alias("low"), F.median("high").alias("high"))
