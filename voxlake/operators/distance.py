"""Nearest points on grids: an exact distance transform in two stages, of planes and of the lines across them.

A plane (one d) of points gives, for every (h, w) that a query can have, the nearest point of that plane: first along the rows,
then across them. What it sends on are its rows, packed. A row of queries (one h) then meets that row of all planes and takes
the best. A task holds one plane, or one row of all planes; the work grows with the volume, not with the square of points.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.operators.grids import XYZ

_FAR = np.iinfo(np.int32).max


def _along_rows(seen: np.ndarray) -> np.ndarray:
    """For each cell of a plane the column of the nearest point in its row, the left one of equals; -1 in empty rows."""
    width = np.arange(seen.shape[1])
    left = np.maximum.accumulate(np.where(seen, width, -_FAR), axis=1)
    right = np.minimum.accumulate(np.where(seen, width, _FAR)[:, ::-1], axis=1)[:, ::-1]
    near = np.where(width - left <= right.astype(np.int64) - width, left, right)
    return np.where(seen.any(1)[:, None], near, -1)


def _plane(spacing: tuple[float, float, float]):
    """Points of one plane, with the box (h0, h1, w0, w1) of the queries -> a row for each h of the box: w0, and for each w the
    squared distance within the plane and the point (h, w)."""

    def run(points: pa.Table) -> pa.Table:
        h, w, h0, h1, w0, w1 = (points.column(c).to_numpy() for c in ("h", "w", "h0", "h1", "w0", "w1"))
        top, low = min(int(h.min()), int(h0[0])), max(int(h.max()), int(h1[0]))
        left, right = min(int(w.min()), int(w0[0])), max(int(w.max()), int(w1[0]))
        seen = np.zeros((low - top + 1, right - left + 1), bool)
        seen[h - top, w - left] = True
        column = _along_rows(seen)[:, int(w0[0]) - left : int(w1[0]) - left + 1]
        across = np.where(column >= 0, ((np.arange(column.shape[1]) + int(w0[0]) - left - column) * spacing[2]) ** 2, np.inf)
        rows = np.flatnonzero(seen.any(1))
        out = []
        for line in range(int(h0[0]), int(h1[0]) + 1):
            total = across[rows] + (((line - top - rows) * spacing[1]) ** 2)[:, None]
            best = total.argmin(0)
            place = np.arange(len(best))
            out.append((line, total[best, place], rows[best] + top, column[rows[best], place] + left))
        first = points.slice(0, 1)
        keys = {c: pa.concat_arrays([first.column(c).combine_chunks()] * len(out)) for c in points.column_names if c not in ("h", "w", "h0", "h1", "w0", "w1")}
        packed = {n: pa.array([np.ascontiguousarray(x[k + 1], t).tobytes() for x in out], pa.binary()) for k, (n, t) in enumerate((("far", np.float64), ("nh", np.int32), ("nw", np.int32)))}
        return pa.table({**keys, "h": pa.array([x[0] for x in out], pa.int32()), "w0": pa.array([int(w0[0])] * len(out), pa.int32()), **packed})

    return run


def _row(spacing: tuple[float, float, float], names: list[str]):
    """Queries of one row and that row of all planes -> each query with its nearest point and the distance."""

    def run(queries: pa.Table, planes: pa.Table) -> pa.Table:
        if not planes.num_rows or not queries.num_rows:
            return _out_schema(queries, names).empty_table()
        planes = planes.sort_by("d")
        at = planes.column("d").to_numpy().astype(np.int64)
        read = lambda c, kind: np.stack([np.frombuffer(x.as_py(), kind) for x in planes.column(c)])
        far, nh, nw = read("far", np.float64), read("nh", np.int32), read("nw", np.int32)
        d, w = queries.column("d").to_numpy().astype(np.int64), queries.column("w").to_numpy() - planes.column("w0")[0].as_py()
        best = np.empty(len(d), np.int64)
        least = np.empty(len(d))
        for start in range(0, len(d), 4096):
            part = slice(start, start + 4096)
            total = far[:, w[part]] + ((at[:, None] - d[part]) * spacing[0]) ** 2
            best[part] = total.argmin(0)
            least[part] = total.min(0)
        columns = [queries.column(c) for c in names]
        columns += [pa.array(at[best].astype(np.int32)), pa.array(nh[best, w]), pa.array(nw[best, w]), pa.array(np.sqrt(least))]
        return pa.Table.from_arrays(columns, schema=_out_schema(queries, names))

    return run


def _out_schema(queries: pa.Table, names: list[str]) -> pa.Schema:
    more = [("nd", pa.int32()), ("nh", pa.int32()), ("nw", pa.int32()), ("distance", pa.float64())]
    return pa.schema([queries.schema.field(c) for c in names] + [pa.field(n, t) for n, t in more])


def nearest(queries: DataFrame, points: DataFrame, keys: Sequence[str], spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """keys, d, h, w, nd, nh, nw, distance: for each of queries(keys, d, h, w) the nearest of points (same columns) with its keys,
    of equally near ones the first in (d, h, w). Queries without any point give no row."""
    keys = list(keys)
    place = [F.col(c).cast("int").alias(c) for c in XYZ]
    queries, points = queries.select(*keys, *place), points.select(*keys, *place)
    box = queries.groupBy(*keys).agg(F.min("h").alias("h0"), F.max("h").alias("h1"), F.min("w").alias("w0"), F.max("w").alias("w1"))
    kinds = dict(queries.dtypes)
    names = [*keys, *XYZ]
    own = ", ".join(f"{c} {kinds[c]}" for c in keys)
    planes = points.join(box, keys).groupBy(*keys, "d").applyInArrow(_plane(spacing), f"{own}, d int, h int, w0 int, far binary, nh binary, nw binary")
    shape = f"{own}, d int, h int, w int, nd int, nh int, nw int, distance double"
    return queries.groupBy(*keys, "h").cogroup(planes.groupBy(*keys, "h")).applyInArrow(_row(spacing, names), shape)
