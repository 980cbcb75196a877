"""NIfTI-1 volumes, plain or gzipped, as tables of voxels.

Files come through Spark's binary source, so any store that Spark reads will do; a task decodes one file at a time (a gzipped one can
only be read from its start, and is held whole) and sends its voxels on in blocks. Only single-file NIfTI-1 with the usual numeric types is read.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Data type codes of the format. Fixed values.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
HEADER_BYTES = 348
_VOXELS = "path string, d int, h int, w int, value double"
_HEADERS = "path string, nd int, nh int, nw int, affine array<array<double>>"
#: Voxels in one block of rows.
BLOCK = 1 << 18


def header(data: bytes) -> tuple[str, tuple[int, int, int], int, float, float, np.ndarray, str]:
    """Byte order, shape, data offset, slope, intercept, 4 x 4 affine and numpy type."""
    order = "<" if struct.unpack_from("<i", data, 0)[0] == HEADER_BYTES else ">"
    if struct.unpack_from(order + "i", data, 0)[0] != HEADER_BYTES or data[344:347] != b"n+1":
        raise ValueError("no single-file NIfTI-1 volume")
    dims = struct.unpack_from(order + "8h", data, 40)
    if any(n > 1 for n in dims[4 : dims[0] + 1]):
        raise ValueError(f"{dims[0]} dimensions; volumes have 3")
    code = struct.unpack_from(order + "h", data, 70)[0]
    offset, slope, intercept = struct.unpack_from(order + "3f", data, 108)
    affine = np.eye(4)
    affine[:3] = np.array(struct.unpack_from(order + "12f", data, 280)).reshape(3, 4)
    if struct.unpack_from(order + "h", data, 254)[0] <= 0:
        affine = np.diag([*struct.unpack_from(order + "3f", data, 80), 1.0])
    return order, tuple(max(n, 1) for n in dims[1:4]), int(offset), slope or 1.0, intercept if slope else 0.0, affine, order + TYPES[code]


def decode(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A volume (d, h, w) of doubles and its affine."""
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    _, shape, offset, slope, intercept, affine, kind = header(data)
    values = np.frombuffer(data, kind, int(np.prod(shape)), offset).reshape(shape, order="F")
    return values * float(slope) + float(intercept), affine


def encode(volume: np.ndarray, affine: np.ndarray | None = None) -> bytes:
    """A gzipped file of float32 values."""
    head = bytearray(352)
    struct.pack_into("<i", head, 0, HEADER_BYTES)
    struct.pack_into("<8h", head, 40, 3, *volume.shape, 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, 16, 32)
    struct.pack_into("<8f", head, 76, *[1.0] * 8)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, *(np.eye(4) if affine is None else affine)[:3].ravel())
    head[344:348] = b"n+1\0"
    return gzip.compress(bytes(head) + volume.astype("<f4").tobytes(order="F"), mtime=0)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of every volume below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.nii*").load(folder).select("path", "content")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path of every volume below a folder; no file is opened, whatever its size."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.nii*").load(folder).select("path")


def chosen(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path and content of these files and of no others."""
    if not paths:
        return spark.createDataFrame([], "path string, content binary")
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def voxels(found: DataFrame) -> DataFrame:
    """path, d, h, w, value of files(path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                volume, _ = decode(content)
                flat, (_, nh, nw) = volume.reshape(-1), volume.shape
                for at in range(0, len(flat), BLOCK):
                    k = np.arange(at, min(at + BLOCK, len(flat)))
                    yield pd.DataFrame({"path": path, "d": (k // (nh * nw)).astype(np.int32), "h": (k // nw % nh).astype(np.int32), "w": (k % nw).astype(np.int32), "value": flat[k]})

    return found.mapInPandas(run, _VOXELS)


def headers(found: DataFrame) -> DataFrame:
    """path, shape and affine, without the voxels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                _, shape, _, _, _, affine, _ = header(data)
                yield pd.DataFrame({"path": [path], "nd": [shape[0]], "nh": [shape[1]], "nw": [shape[2]], "affine": [affine.tolist()]})

    return found.mapInPandas(run, _HEADERS)


def write(spark: SparkSession, volumes: DataFrame, folder: str) -> DataFrame:
    """name and content of volumes(name, d, h, w, value): one group is one volume, written as one row of bytes to Parquet."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        shape = tuple(int(rows[c].max()) + 1 for c in "dhw")
        out = np.zeros(shape)
        out[rows["d"], rows["h"], rows["w"]] = rows["value"]
        return pd.DataFrame({"name": [rows["name"].iloc[0]], "content": [encode(out)]})

    packed = volumes.groupBy("name").applyInPandas(pack, "name string, content binary")
    packed.write.parquet(folder)
    return spark.read.parquet(folder)


