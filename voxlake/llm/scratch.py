"""Where the jobs of this subpackage cut lineage, and how much a Python task holds at once."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Used only where spark.checkpoint.dir is unset, and only for a local master, which has one disk.
LOCAL_DEFAULT = "file:///tmp/checkpoints/voxlake"
#: Bytes of one batch that goes to Python: whole texts, so that a few thousand long ones don't meet in one batch.
BATCH_BYTES = "4m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: A job's shuffle files go when it ends: its result is written, and nothing reads them again.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Where the tables of `materialise` are.
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; without one, a local folder for local masters and an error for clusters."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_DEFAULT


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _setting(spark: SparkSession, **settings: str) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def small_batches(spark: SparkSession) -> contextlib.AbstractContextManager:
    """Jobs within send batches of BATCH_BYTES to Python."""
    return _setting(spark, **{_BATCH: BATCH_BYTES})


def bound_batches(spark: SparkSession) -> None:
    """From now on the session sends batches of BATCH_BYTES: for queries whose Python stages run when the caller's job does."""
    spark.conf.set(_BATCH, BATCH_BYTES)


def give_back() -> None:
    """Return memory that Arrow and malloc hold for later: Python workers live on, and an executor's memory counts all of them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """run, a function over batches, giving unused memory back when a task ends."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: later stages start from files that outlive executors."""
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    with _setting(spark, **{_BATCH: BATCH_BYTES, _TIDY: "true"}):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of `materialise` that no later job reads. Others are left alone."""
    for table in tables:
        path = _WRITTEN.pop(table, None)
        if path is not None:
            jvm = table.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
