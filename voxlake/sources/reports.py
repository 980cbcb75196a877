"""Report files, and runs that can be taken up again: results with a manifest of finished tasks, a guarded config."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voxlake.plans.experiments import remaining

#: Attempts whose folders are named in a filter and whose order is broadcast; more are joined.
PRUNED_ATTEMPTS = 10_000


def write_csv(report: DataFrame, path: str) -> None:
    """A folder of CSV with a header; other suffixes are errors."""
    if not path.endswith(".csv"):
        raise ValueError(f"{path}: reports are .csv")
    report.write.mode("overwrite").option("header", True).csv(path)


def union(*reports: DataFrame) -> DataFrame:
    """All rows of reports that share some columns; a column that a report lacks is null in its rows."""
    rows = reports[0]
    for report in reports[1:]:
        rows = rows.unionByName(report, allowMissingColumns=True)
    return rows


def write_by_type(reports: Mapping[str, DataFrame], path: str) -> list[str]:
    """One report for each type, its name before the suffix."""
    paths = [path.removesuffix(".csv") + f"_{kind}.csv" for kind in reports]
    for report, at in zip(reports.values(), paths, strict=True):
        write_csv(report, at)
    return paths


class Run:
    """Results of tasks in a shared folder. Appending writes an attempt's rows and the keys of its tasks into folders of their own, and last
    a manifest that names the attempt: one small file, made in one step, also on stores that have no renames. Attempts without a manifest
    don't count, whatever they left; a task that several attempts finished counts once, in the first of them. So a run that was
    stopped at any moment goes on with the rest, and ends with the rows of one that never stopped."""

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], partition: str | None = None) -> None:
        self.spark, self.folder, self.keys, self.partition = spark, folder.rstrip("/"), [*keys], partition

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _exists(self, name: str) -> bool:
        store, path = self._path(name)
        return store.exists(path)

    def _names(self, name: str) -> list[str]:
        store, path = self._path(name)
        return sorted(f.getPath().getName() for f in store.listStatus(path)) if store.exists(path) else []

    def _attempts(self) -> dict[str, str]:
        """Committed attempts, in the order of their commits: attempt -> manifest."""
        return {m.split("-", 1)[1].removesuffix(".json"): m for m in self._names("manifest") if m.endswith(".json")}

    def _commit(self, attempt: str, schemas: Mapping[str, StructType]) -> None:
        store, path = self._path(f"manifest/{time.time_ns():020d}-{attempt}.json")
        out = store.create(path, False)
        try:
            out.write(bytearray(json.dumps({"attempt": attempt} | {k: v.jsonValue() for k, v in schemas.items()}).encode()))
        finally:
            out.close()

    def append(self, rows: DataFrame, tasks: DataFrame | None = None) -> None:
        """Rows of finished tasks. tasks: their keys, where some have no rows; else the keys in rows."""
        attempt = uuid.uuid4().hex
        writer = rows.write.mode("errorifexists")
        (writer.partitionBy(self.partition) if self.partition else writer).parquet(f"{self.folder}/rows/attempt={attempt}")
        if tasks is None:
            tasks = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/rows/attempt={attempt}")
        tasks = tasks.select(*self.keys).distinct()
        tasks.write.parquet(f"{self.folder}/tasks/attempt={attempt}")
        self._commit(attempt, {"rows": rows.schema, "tasks": tasks.schema})

    def _committed(self, name: str) -> DataFrame | None:
        """A table's rows of committed attempts, with attempt and commit (their order)."""
        order = self._attempts()
        if not order:
            return None
        names = self.spark.createDataFrame([*order.items()], "attempt string, commit string")
        saved = self.spark.read.text(f"{self.folder}/manifest/{next(iter(order.values()))}", wholetext=True).first()[0]
        schema = StructType.fromJson(json.loads(saved)[name]).add("attempt", "string")
        rows = self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        if len(order) > PRUNED_ATTEMPTS:
            return rows.join(names, "attempt")
        return rows.where(F.col("attempt").isin(*order)).join(F.broadcast(names), "attempt")

    def done(self) -> DataFrame | None:
        """The keys of finished tasks and the attempt that counts for each."""
        tasks = self._committed("tasks")
        if tasks is None:
            return None
        return tasks.groupBy(*self.keys).agg(F.min(F.struct("commit", "attempt")).alias("_first")).select(*self.keys, F.col("_first.attempt").alias("attempt"))

    def rows(self) -> DataFrame | None:
        rows, done = self._committed("rows"), self.done()
        if rows is None:
            return None
        names = {k: f"_{k}" for k in [*self.keys, "attempt"]}
        met = rows.join(done.withColumnsRenamed(names), [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()], "left_semi")
        return met.drop("attempt", "commit")

    def todo(self, tasks: DataFrame) -> DataFrame:
        done = self.done()
        return tasks if done is None else remaining(tasks, done, self.keys)

    def guard(self, config: Mapping) -> None:
        """The first call keeps the config; later ones must bring the same."""
        rows = [(k, json.dumps(v, sort_keys=True)) for k, v in sorted(config.items())]
        now = self.spark.createDataFrame(rows, "key string, value string")
        if not self._exists("config"):
            now.coalesce(1).write.parquet(f"{self.folder}/config")
            return
        diff = config_diff(self.spark.read.parquet(f"{self.folder}/config"), now).collect()
        if diff:
            raise ValueError("the config differs: " + "; ".join(f"{r['key']}: {r['saved']} is now {r['current']}" for r in diff))

    def finish(self) -> None:
        """Mark the run as done; what attempts without a manifest left is removed."""
        kept = self._attempts()
        for table in ("rows", "tasks"):
            for name in self._names(table):
                if name.startswith("attempt=") and name.removeprefix("attempt=") not in kept:
                    store, path = self._path(f"{table}/{name}")
                    store.delete(path, True)
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.folder}/finished")

    def finished(self) -> bool:
        return self._exists("finished")


def config_diff(saved: DataFrame, current: DataFrame) -> DataFrame:
    """key, saved, current where they differ."""
    both = saved.withColumnRenamed("value", "saved").join(current.withColumnRenamed("value", "current"), "key", "full")
    return both.where(~F.col("saved").eqNullSafe(F.col("current"))).orderBy("key")


def stage_totals(stages: DataFrame) -> DataFrame:
    """run, stages, stages_sum_sec, longest of stages(run, tag, sec)."""
    return stages.groupBy("run").agg(F.count(F.lit(1)).alias("stages"), F.sum("sec").alias("stages_sum_sec"), F.max_by("tag", F.struct("sec", "tag")).alias("longest"))
