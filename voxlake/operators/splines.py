"""Zoom of volumes by cubic B-splines.

The spline that passes through all voxels has coefficients that a recursion along each line gives, once forwards and once backwards, the
volume mirrored at its ends; each new voxel then takes four of them along each axis. Both steps are separable: planes across h are
zoomed along d and w where they are, then planes across d along h, if that axis changes. A task holds one plane at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.operators.grids import XYZ

_POLE = 3**0.5 - 2


def coefficients(x: np.ndarray) -> np.ndarray:
    """B-spline coefficients along the first axis, mirrored about the end values."""
    n = len(x)
    if n == 1:
        return x
    k = np.arange(n)
    weight = _POLE**k + np.where((k > 0) & (k < n - 1), _POLE ** (2 * n - 2 - k), 0.0)
    out = np.empty_like(x, dtype=np.float64)
    out[0] = 6 * np.tensordot(weight, x, 1) / (1 - _POLE ** (2 * n - 2))
    for i in range(1, n):
        out[i] = 6 * x[i] + _POLE * out[i - 1]
    out[-1] = _POLE / (_POLE**2 - 1) * (_POLE * out[-2] + out[-1])
    for i in range(n - 2, -1, -1):
        out[i] = _POLE * (out[i + 1] - out[i])
    return out


def zoom_line(x: np.ndarray, new: int, there: np.ndarray | None = None) -> np.ndarray:
    """x at `new` places along its first axis, the ends at the ends. there: which of x there are; others are 0 and have no coefficient."""
    n = len(x)
    at = np.arange(new) * ((n - 1) / (new - 1)) if new > 1 else np.zeros(1)
    low = np.floor(at).astype(int)
    t = (at - low).reshape(-1, *[1] * (x.ndim - 1))
    weights = ((1 - t) ** 3 / 6, (4 - 6 * t**2 + 3 * t**3) / 6, (4 - 6 * (1 - t) ** 2 + 3 * (1 - t) ** 3) / 6, t**3 / 6)
    c = coefficients(x) if there is None else np.where(there, coefficients(np.where(there, x, 0.0)), 0.0)
    out = 0.0
    for w, place in zip(weights, _taps(low, n), strict=True):
        out = out + w * c[place]
    return out


def _taps(low: np.ndarray, n: int) -> list[np.ndarray]:
    """Where the four coefficients about places are, mirrored at the ends."""
    period = max(2 * n - 2, 1)
    places = [np.abs(low + k - 1) % period for k in range(4)]
    return [np.where(p > n - 1, period - p, p) for p in places]


def reached(there: np.ndarray, new: int) -> np.ndarray:
    """Which of the `new` places along the first axis have a coefficient."""
    n = len(there)
    low = np.floor(np.arange(new) * ((n - 1) / (new - 1)) if new > 1 else np.zeros(1)).astype(int)
    return np.any([there[p] for p in _taps(low, n)], 0)


def _plane(keys: Sequence[str], across: str, new: Callable[[int, str], int], partial: bool, kinds: dict[str, str]):
    """The voxels of one plane across an axis -> those of the plane zoomed along its axes, the first one first; across d along h alone."""
    a, b = (c for c in XYZ if c != across)

    def run(rows: pa.Table) -> pa.Table:
        i, j = (rows.column(c).to_numpy().astype(np.int64) for c in (a, b))
        shape = tuple(rows.column(f"_n{c}")[0].as_py() for c in (a, b)) if partial else (int(i.max()) + 1, int(j.max()) + 1)
        if len(np.unique(i * shape[1] + j)) != rows.num_rows or (rows.num_rows != shape[0] * shape[1] and not partial):
            raise ValueError(f"the plane at {across} = {rows.column(across)[0]} isn't whole")
        y, there = np.zeros(shape), np.zeros(shape, bool)
        y[i, j], there[i, j] = rows.column("_x").to_numpy(), True
        for axis in (a,) if across == "d" else (a, b):
            size = new(len(y) if axis == a else y.shape[1], axis)
            if axis == b:
                y, there = y.T, there.T
            if size != len(y):
                y, there = zoom_line(y, size, there if partial else None), reached(there, size)
            if axis == b:
                y, there = y.T, there.T
        at = np.argwhere(there).T.astype(np.int32)
        first = rows.select([*keys, across, *(k for k in kinds if k.startswith("_n"))]).slice(0, 1)
        columns = {k: pa.chunked_array([first.column(k).combine_chunks().take(pa.array(np.zeros(at.shape[1], np.int64)))]) for k in first.column_names}
        columns |= {a: pa.array(at[0]), b: pa.array(at[1]), "_x": pa.array(y[there])}
        return pa.table({k: columns[k] for k in kinds})

    return run


def zoomed(voxels: DataFrame, factors: Sequence[float], column: str = "value", keys: Sequence[str] = ("vid",), partial: bool = False) -> DataFrame:
    """keys, d, h, w and the column of whole volumes with round(n * factor) voxels along each axis, half to even and 1 at least. A plane that
    isn't whole is an error; a null value makes what its lines reach NaN; an empty table gives an empty one. partial: voxels that
    aren't there are 0 and have no coefficient, along d, then w, then h; new voxels that no coefficient reaches are left out."""
    sizes = dict(zip(XYZ, (float(f) for f in factors), strict=True))
    new = lambda n, axis: max(int(np.rint(n * sizes[axis])), 1)
    rows = voxels.select(*keys, *[F.col(c).cast("int").alias(c) for c in XYZ], F.coalesce(F.col(column).cast("double"), F.lit(float("nan"))).alias("_x"))
    if partial:
        rows = rows.join(rows.groupBy(*keys).agg(*[(F.max(c) + 1).alias(f"_n{c}") for c in XYZ]), [*keys])
    kinds = dict(rows.dtypes)
    shape = ", ".join(f"`{k}` {v}" for k, v in kinds.items())
    rows = rows.groupBy(*keys, "h").applyInArrow(_plane(keys, "h", new, partial, kinds), shape)
    if sizes["h"] != 1:
        # the zoomed sides of planes across d
        rows = rows.withColumn("_nw", F.greatest(F.rint(F.col("_nw") * sizes["w"]).cast("int"), F.lit(1))) if partial else rows
        rows = rows.groupBy(*keys, "d").applyInArrow(_plane(keys, "d", new, partial, kinds), shape)
    return rows.select(*keys, *XYZ, F.col("_x").alias(column))
