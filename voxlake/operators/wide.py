"""Principal components and partial least squares of vectors that are too long for a matrix of their length squared.

The driver never sees such a matrix. It holds a block of basis vectors; a job multiplies all rows with the block (every task adds up its own
rows' products, chunks of which are added in the cluster) and gives the matrix's product with it. Blocks so found span a Krylov space,
within which the small problem is solved exactly; when the residual of every wanted direction is below `tolerance` times the largest
value, they are done. A basis of more than `MAX_BASIS` vectors is cut back to the best directions. What is broadcast and what comes back is
one block: vector length x (wanted + `EXTRA`).
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from voxlake.scratch import dropped, written

#: Vectors of a block beyond the wanted ones, the most of a basis, and the most jobs of a fit.
EXTRA, MAX_BASIS, MAX_JOBS = 8, 256, 200
#: Bytes of a block that is broadcast, and numbers of one chunk of a sum.
MAX_BLOCK_BYTES, CHUNK = 1 << 30, 1 << 16
#: Rows reach Python in batches of so many bytes: long vectors by the thousand would not fit.
BATCH_BYTES = "16m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_PARTS = "chunk int, data binary"


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)


def _chunks(flat: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(flat), CHUNK):
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([k // CHUNK], pa.int32()), "data": pa.array([flat[k : k + CHUNK].tobytes()], pa.binary())})


def _add(rows: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x.as_py(), np.float64) for x in rows.column("data")], 0)
    return pa.table({"chunk": rows.column("chunk")[:1], "data": pa.array([total.tobytes()], pa.binary())})


def _vectors(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.where(np.isfinite(x), x, 0.0)


def total(rows: DataFrame, size: int, run: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum over all batches of rows of run(batch), an array of `size` numbers."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                out += run(batch).ravel()
        yield from _chunks(out)

    out = np.zeros(size)
    with _small_batches(rows.sparkSession):
        for row in rows.mapInArrow(own, _PARTS).groupBy("chunk").applyInArrow(_add, _PARTS).toLocalIterator():
            part = np.frombuffer(row["data"], np.float64)
            out[row["chunk"] * CHUNK : row["chunk"] * CHUNK + len(part)] = part
    return out


def krylov(apply: Callable[[np.ndarray], np.ndarray], channels: int, wanted: int, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, descending, and vectors (channels x wanted) of a symmetric matrix without negative ones, known only by its
    product with a block."""
    wanted = min(wanted, channels)
    size = min(wanted + EXTRA, channels)
    if size * channels * 8 > MAX_BLOCK_BYTES:
        raise ValueError(f"{wanted} directions of {channels} channels are more than one block of {MAX_BLOCK_BYTES} bytes")
    block = np.linalg.qr(np.random.default_rng(0).normal(size=(channels, size)))[0]
    basis, image = np.zeros((channels, 0)), np.zeros((channels, 0))
    for _ in range(MAX_JOBS):
        basis, image = np.hstack([basis, block]), np.hstack([image, apply(block)])
        small = basis.T @ image
        values, mix = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values, kind="stable")
        values, mix = values[order], mix[:, order]
        vectors, images = basis @ mix, image @ mix
        residual = images[:, :wanted] - vectors[:, :wanted] * values[:wanted]
        if np.linalg.norm(residual, axis=0).max() <= tolerance * max(values[0], 1e-300) or basis.shape[1] == channels:
            return np.maximum(values[:wanted], 0), vectors[:, :wanted]
        if basis.shape[1] + size > max(MAX_BASIS, 3 * size):
            basis, image = vectors[:, : 2 * size], images[:, : 2 * size]
            residual = images[:, :size] - vectors[:, :size] * values[:size]
        else:
            residual = image[:, -block.shape[1] :]
        for _ in range(2):
            residual = residual - basis @ (basis.T @ residual)
        left, strength, _ = np.linalg.svd(residual, full_matrices=False)
        block = left[:, strength > max(values[0], 1e-300) * 1e-14][:, : channels - basis.shape[1]]
        # rounding leaves a little of the basis in directions that are almost nothing
        block = np.linalg.qr(block - basis @ (basis.T @ block))[0]
        if not block.shape[1]:
            return np.maximum(values[:wanted], 0), vectors[:, :wanted]
    raise RuntimeError(f"{MAX_JOBS} jobs don't separate the directions")


def principal(rows: DataFrame, channels: int, wanted: int, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, largest variances and their directions (channels x wanted) of rows(x), array<double>; components that aren't finite are 0."""
    rows = rows.select("x")
    sums = total(rows, channels + 1, lambda batch: np.append(_vectors(batch.column(0)).sum(0), batch.num_rows))
    n, mean = sums[-1], sums[:-1] / max(sums[-1], 1)
    if not n:
        raise ValueError("no rows to fit components to")

    def apply(block: np.ndarray) -> np.ndarray:
        held = rows.sparkSession.sparkContext.broadcast((block, mean))

        def product(batch: pa.RecordBatch) -> np.ndarray:
            q, centre = held.value
            x = _vectors(batch.column(0)) - centre
            return x.T @ (x @ q)

        out = total(rows, block.size, product).reshape(block.shape) / n
        held.destroy()
        return out

    values, vectors = krylov(apply, channels, min(wanted, int(n)), tolerance)
    return mean, values, vectors


def least_squares(rows: DataFrame, channels: int, wanted: int, alpha: Sequence[float], ridge: float, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Singular values, directions of y and of x (channels x wanted) of the scaled, ladder-weighted cross-covariance of
    rows(group, w, x, y). group: `level|pair`; every group is centred by its own weighted means; the scales are of the last level."""
    spark, c, last = rows.sparkSession, channels, len(alpha) - 1
    rows = rows.select("group", "w", "x", "y")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist())
            w, x, y = batch.column(1).to_numpy(zero_copy_only=False), _vectors(batch.column(2)), _vectors(batch.column(3))
            for name in set(names.tolist()):
                at = names == name
                wx, wy = x[at] * w[at, None], y[at] * w[at, None]
                part = np.concatenate([[w[at].sum()], wx.sum(0), wy.sum(0), (wx * x[at]).sum(0), (wy * y[at]).sum(0)])
                sums[name] = sums.get(name, 0) + part
        for name, flat in sums.items():
            yield pa.RecordBatch.from_pydict({"group": pa.array([name], pa.string()), "data": pa.array([flat.tobytes()], pa.binary())})

    def add(part: pa.Table) -> pa.Table:
        flat = np.sum([np.frombuffer(v.as_py(), np.float64) for v in part.column("data")], 0)
        return pa.table({"group": part.column("group")[:1], "data": pa.array([flat.tobytes()], pa.binary())})

    shape = "group string, data binary"
    with _small_batches(spark):
        groups = written(rows.mapInArrow(partial, shape).groupBy("group").applyInArrow(add, shape), "groups")

    def split(row: bytes) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        flat = np.frombuffer(row, np.float64)
        return flat[0], *flat[1:].reshape(4, c)

    level = lambda name: int(name.split("|", 1)[0])

    def spread(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(2 * c + 1)
        for name, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if level(name) == last:
                w, sx, sy, xx, yy = split(row)
                out += np.concatenate([xx - sx**2 / max(w, 1e-8), yy - sy**2 / max(w, 1e-8), [w]])
        return out

    found = total(groups, 2 * c + 1, spread)
    scale_x, scale_y = (1 / np.sqrt(v / (found[-1] + 1e-8) + ridge) for v in (found[:c], found[c : 2 * c]))

    def product(block: np.ndarray, onto: int) -> np.ndarray:
        """onto 0: the matrix times block (of y's side); 1: its transpose times block (of x's side)."""
        near, far = (scale_x, scale_y) if onto == 0 else (scale_y, scale_x)
        held = spark.sparkContext.broadcast(far[:, None] * block)

        def of_rows(batch: pa.RecordBatch) -> np.ndarray:
            weight = np.array([alpha[level(name)] for name in batch.column(0).to_pylist()]) * batch.column(1).to_numpy(zero_copy_only=False)
            x, y = _vectors(batch.column(2)), _vectors(batch.column(3))
            x, y = (x, y) if onto == 0 else (y, x)
            return (x * weight[:, None]).T @ (y @ held.value)

        def of_groups(batch: pa.RecordBatch) -> np.ndarray:
            out = np.zeros(block.shape)
            for name, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w, sx, sy, _, _ = split(row)
                sx, sy = (sx, sy) if onto == 0 else (sy, sx)
                out += np.outer(sx, (alpha[level(name)] / max(w, 1e-8)) * (sy @ held.value))
            return out

        out = (total(rows, block.size, of_rows) - total(groups, block.size, of_groups)).reshape(block.shape) * near[:, None]
        held.destroy()
        return out

    values, right = krylov(lambda block: product(product(block, 0), 1), c, wanted, tolerance)
    singular = np.sqrt(values)
    left = product(right, 0) / np.maximum(singular, 1e-300)
    dropped(groups)
    return singular, right, left
