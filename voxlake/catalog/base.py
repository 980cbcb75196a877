"""How queries are listed, and the SQL of the common views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.sources import views

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a query under its function's name."""

        def keep(query: Query) -> Query:
            self.queries[query.__name__] = query
            if sql:
                self.sql[query.__name__] = sql
            return query

        return keep


def r6(x: Column | str) -> Column:
    """Rounded to six digits, without a negative zero: how figures are compared between engines."""
    return F.round(x, 6) + F.lit(0.0)


def tok(spark: SparkSession, folder: str) -> DataFrame:
    return views.tokens(views.table(spark, folder, "embeddings")).withColumn("vox", F.col("vec_id"))


def vox(spark: SparkSession, folder: str) -> DataFrame:
    return views.scalars(views.table(spark, folder, "embeddings"))


def inten(spark: SparkSession, folder: str) -> DataFrame:
    return views.intensities(views.table(spark, folder, "lineitem"))


def hps(spark: SparkSession, folder: str) -> DataFrame:
    return views.search_rows(views.table(spark, folder, "lineitem"))


def entities(spark: SparkSession, folder: str) -> DataFrame:
    return tok(spark, folder).select("vid", "patient", "modality").distinct().withColumn("group_id", F.lit(0))


TOK = """tok AS (
  SELECT concat('s', (vec_id % 4) // 2, '__m', CASE WHEN vec_id % 2 = 0 THEN 'MR' ELSE 'CT' END, '__iP', (vec_id % 4) // 2) AS vid,
         CAST((vec_id % 4) // 2 AS INTEGER) AS patient, CASE WHEN vec_id % 2 = 0 THEN 'MR' ELSE 'CT' END AS modality,
         CAST((vec_id // 4) // 25 AS INTEGER) AS d, CAST(((vec_id // 4) // 5) % 5 AS INTEGER) AS h, CAST((vec_id // 4) % 5 AS INTEGER) AS w,
         CAST(embedding AS DOUBLE[]) AS feat, label AS seg, vec_id % 7 <> 0 AS msk, vec_id, vec_id AS vox
  FROM embeddings)"""
VOX = TOK + """, vox AS (SELECT vid, modality, d, h, w, 100 * feat[1] AS value, seg, msk FROM tok)"""
INTEN = """inten AS (
  SELECT concat('v', l_suppkey % 5) AS vid, CASE WHEN l_returnflag = 'R' THEN 'CT' ELSE 'MR' END AS modality,
         l_extendedprice AS value, l_quantity > 10 AS msk FROM lineitem)"""
HPS = """hps AS (
  SELECT l_orderkey % 4 AS fold, l_returnflag AS feat, l_linestatus AS reg, l_linenumber AS hps,
         concat('e', 20 * (1 + l_suppkey % 3), '_s', l_partkey % 2) AS displacement, l_discount * 10 AS dice FROM lineitem)"""
ENT = TOK + """, ent AS (SELECT DISTINCT vid, patient, modality FROM tok)"""
PAIRS = ENT + """, pairs AS (
  SELECT concat(q.vid, '|', k.vid) AS pair_id, q.vid AS query_vid, k.vid AS key_vid,
         CASE WHEN q.vid = k.vid THEN 'SC' WHEN q.modality = k.modality AND q.patient <> k.patient THEN 'DS'
              WHEN q.modality <> k.modality AND q.patient = k.patient THEN 'DM' ELSE 'G' END AS seg_type
  FROM ent q, ent k)"""
#: A displacement on the grid of each entity, away from halves.
FIELD = """fld AS (SELECT vid AS pair_id, d, h, w, 0.1 * d + 0.8 AS ud, -0.1 * h AS uh, 0.3 AS uw FROM tok)"""


def field(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("vid").alias("pair_id"), "d", "h", "w", (0.1 * F.col("d") + 0.8).alias("ud"), (-0.1 * F.col("h")).alias("uh"), F.lit(0.3).alias("uw"))
