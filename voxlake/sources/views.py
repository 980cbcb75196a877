"""Volumetric views of plain tables: vectors on a voxel grid, scalar volumes, intensities and search results.

Every view is a projection of one scan, so filters and column choices made on it reach the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokens(vectors: DataFrame) -> DataFrame:
    """One quad: four entities (two patients, two modalities) of 5 x 5 x N voxels with a vector, a label and a mask."""
    patient = F.expr("cast((vec_id % 4) div 2 as int)")
    modality = F.when(F.col("vec_id") % 2 == 0, "MR").otherwise("CT")
    place = F.expr("vec_id div 4")
    return vectors.select(
        F.concat(F.lit("s"), patient, F.lit("__m"), modality, F.lit("__iP"), patient).alias("vid"),
        patient.alias("patient"),
        modality.alias("modality"),
        F.expr("cast((vec_id div 4) div 25 as int)").alias("d"),
        F.expr("cast(((vec_id div 4) div 5) % 5 as int)").alias("h"),
        (place % 5).cast("int").alias("w"),
        F.col("embedding").cast("array<double>").alias("feat"),
        F.col("label").alias("seg"),
        (F.col("vec_id") % 7 != 0).alias("msk"),
        "vec_id",
    )


def scalars(vectors: DataFrame) -> DataFrame:
    """The first channel of each voxel as a scalar volume."""
    return tokens(vectors).select("vid", "modality", "d", "h", "w", (100 * F.element_at("feat", 1)).alias("value"), "seg", "msk")


def intensities(lineitem: DataFrame) -> DataFrame:
    """Five volumes of two modalities."""
    return lineitem.select(
        F.concat(F.lit("v"), F.col("l_suppkey") % 5).alias("vid"),
        F.when(F.col("l_returnflag") == "R", "CT").otherwise("MR").alias("modality"),
        F.col("l_extendedprice").alias("value"),
        (F.col("l_quantity") > 10).alias("msk"),
    )


def search_rows(lineitem: DataFrame) -> DataFrame:
    """Results of a hyper-parameter search: one Dice for each fold, feature, method, combination and displacement."""
    return lineitem.select(
        (F.col("l_orderkey") % 4).alias("fold"),
        F.col("l_returnflag").alias("feat"),
        F.col("l_linestatus").alias("reg"),
        F.col("l_linenumber").alias("hps"),
        F.concat(F.lit("e"), (20 * (1 + F.col("l_suppkey") % 3)).cast("string"), F.lit("_s"), (F.col("l_partkey") % 2).cast("string")).alias("displacement"),
        (F.col("l_discount") * 10).alias("dice"),
    )
