"""A bounded table of counters over hashes, filled by one pass over a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from voxlake.llm.scratch import released, small_batches

CHUNK = 4096


def places(hashes: np.ndarray, size: int) -> np.ndarray:
    """The counter of each 64-bit hash. size: a power of two."""
    return (hashes >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(counts.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            sums[chunk] = sums.get(chunk, 0) + _unpacked(counts.as_py())
    for chunk, counts in sums.items():
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "counts": [_packed(counts)]})


def count(rows: DataFrame, hashes: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """hashes gives a batch's distinct hashes and their counts. How often each counter's hashes occur in all of rows. Tasks add up their own counts and send the chunks that aren't
    all zero; the driver gets `size` counters, whatever the input's size."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int32)
        for batch in batches:
            found, counts = hashes(batch)
            np.add.at(total, places(found, size), counts)
        chunks = total.reshape(-1, CHUNK)
        some = np.flatnonzero(chunks.any(1))
        for at in range(0, len(some), 64):
            part = some[at : at + 64]
            yield pa.RecordBatch.from_pydict({"chunk": part.astype(np.int32), "counts": [_packed(chunks[k]) for k in part]})

    shape = "chunk int, counts binary"
    out = np.zeros(size, np.int64)
    with small_batches(rows.sparkSession):
        for row in rows.mapInArrow(released(own), shape).repartition("chunk").mapInArrow(_sum, shape).toLocalIterator():
            out[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = _unpacked(bytes(row["counts"]))
    return out
