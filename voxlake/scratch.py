"""Written tables in the folder that the cluster shares: where long plans are cut."""

from __future__ import annotations

import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: Only for local masters without spark.checkpoint.dir, which have one disk.
LOCAL_DEFAULT = "file:///tmp/checkpoints/voxlake"
_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; without one, a local folder for local masters and an error for clusters."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_DEFAULT


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written and read back: what follows starts from files that outlive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _written[table] = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete tables of `written` that no later job reads; others are left alone."""
    for table in tables:
        path = _written.pop(table, None)
        if path is not None:
            place = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
