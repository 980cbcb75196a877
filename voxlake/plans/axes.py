"""Features of volumes from slices along three axes: choose slices, encode, project, fill the depth, lay over voxels, join."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.operators import encoders, features, grids, slices
from voxlake.operators.projection import PCA

AXES = ("x", "y", "z")


def per_axis(value, axes: tuple[str, ...] = AXES) -> dict[str, object]:
    """A parameter for each axis: from a mapping with all axes, a list of as many, or one value for all."""
    if isinstance(value, Mapping):
        if set(value) != set(axes):
            raise ValueError(f"{sorted(value)} aren't the axes {axes}")
        return dict(value)
    if isinstance(value, list | tuple):
        if len(value) != len(axes):
            raise ValueError(f"{len(value)} values for {len(axes)} axes")
        return dict(zip(axes, value, strict=True))
    return dict.fromkeys(axes, value)


@dataclass(frozen=True)
class Axis:
    """One axis. patch: pixels of a token's side; every: which interior slices are encoded; channels: kept components."""

    dim: str
    patch: int = 2
    every: int = 1
    channels: int | None = None
    encoder: str = "patch_statistics"

    def tokens(self, volumes: DataFrame) -> DataFrame:
        """Tokens of the chosen slices, padded to whole patches with each entity's background."""
        cut = slices.serialize(volumes.select("vid", "d", "h", "w", "value"), self.dim)
        padded = grids.pad_slices(cut, self.patch, slices.background(cut)).withColumn("dim", F.lit(self.dim)).withColumn("is_end", F.lit(False))
        return encoders.extract(encoders.get(self.encoder, patch=self.patch), slices.subsample(padded, self.every))

    def fit(self, volumes: DataFrame) -> PCA | None:
        return PCA.fit(self.tokens(volumes), self.channels) if self.channels else None

    def transform(self, volumes: DataFrame, model: PCA | None = None) -> DataFrame:
        """vid, d, h, w, feat for every voxel."""
        found = self.tokens(volumes)
        if model is not None:
            found = found.withColumn("feat", model.transform(F.col("feat")))
        index, row, col = slices.PLANES[self.dim]
        sizes = grids.shapes(volumes)
        depth = found.select("vid", "tok_y", "tok_x").distinct().join(sizes, "vid").select("vid", "tok_y", "tok_x", F.col(f"n{index}").alias("depth"))
        whole = slices.interpolate(found, depth, ["vid", "tok_y", "tok_x"]).join(sizes, "vid")
        (top, _), (left, _) = grids.padding(F.col(f"n{row}"), self.patch), grids.padding(F.col(f"n{col}"), self.patch)
        side = F.sequence(F.lit(0), F.lit(self.patch - 1))
        laid = whole.withColumns({"_top": top, "_left": left}).withColumn("_a", F.explode(side)).withColumn("_b", F.explode(side))
        laid = laid.select("vid", "slice_idx", (F.col("tok_y") * self.patch + F.col("_a") - F.col("_top")).alias("row"), (F.col("tok_x") * self.patch + F.col("_b") - F.col("_left")).alias("col"), "feat", f"n{row}", f"n{col}")
        inside = laid.where(f"row BETWEEN 0 AND n{row} - 1 AND col BETWEEN 0 AND n{col} - 1")
        return inside.select("vid", F.col("slice_idx").alias(index), F.col("row").alias(row), F.col("col").alias(col), "feat").select("vid", "d", "h", "w", "feat")


@dataclass
class ThreeAxes:
    """The same along x, y and z; voxels of the three are joined once, on one key."""

    patch: object = 2
    every: object = 1
    channels: object = None
    combine: str = "cat"

    def __post_init__(self) -> None:
        p, e, c = per_axis(self.patch), per_axis(self.every), per_axis(self.channels)
        self.axes = {a: Axis(a, p[a], e[a], c[a]) for a in AXES}
        self.models: dict[str, PCA | None] = dict.fromkeys(AXES)

    def fit(self, volumes: DataFrame) -> ThreeAxes:
        self.models = {a: axis.fit(volumes) for a, axis in self.axes.items()}
        return self

    def transform(self, volumes: DataFrame) -> DataFrame:
        parts = [axis.transform(volumes, self.models[a]) for a, axis in self.axes.items()]
        return {"cat": features.concatenated, "sum": features.summed, "l2sum": features.unit_summed}[self.combine](*parts)
