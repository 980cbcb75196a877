"""Which entities meet: quads, doubles, fixed and moving pairs. Tables of entities are small; all joins are on keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.operators.numbering import ordered


def _kind() -> Column:
    """SC: the same entity; DS: another subject; DM: another modality; G: both differ."""
    same_mod, same_patient = F.col("q.modality") == F.col("k.modality"), F.col("q.patient") == F.col("k.patient")
    return F.when(F.col("q.vid") == F.col("k.vid"), "SC").when(same_mod & ~same_patient, "DS").when(~same_mod & same_patient, "DM").otherwise("G")


def quads(entities: DataFrame) -> DataFrame:
    """The 16 pairs of every group of entities(group_id, vid, modality, patient): pair_id, query_vid, key_vid, seg_type."""
    q, k = entities.alias("q"), entities.alias("k")
    pair = F.concat_ws("|", "q.vid", "k.vid")
    return q.join(k, F.col("q.group_id") == F.col("k.group_id")).select(
        F.col("q.group_id").alias("group_id"), pair.alias("pair_id"), F.col("q.vid").alias("query_vid"), F.col("k.vid").alias("key_vid"), _kind().alias("seg_type")
    )


def doubles(entities: DataFrame) -> DataFrame:
    """The 4 pairs of each patient's entities; the type names both modalities."""
    q, k = entities.alias("q"), entities.alias("k")
    return q.join(k, F.col("q.patient") == F.col("k.patient")).select(
        F.concat_ws("|", "q.vid", "k.vid").alias("pair_id"),
        F.col("q.vid").alias("query_vid"),
        F.col("k.vid").alias("key_vid"),
        F.concat(F.col("q.modality"), F.lit("->"), F.col("k.modality")).alias("seg_type"),
    )


def quad_faults(entities: DataFrame) -> DataFrame:
    """Groups that aren't 4 entities of 2 patients and 2 modalities."""
    seen = entities.groupBy("group_id").agg(
        F.count_distinct("vid").alias("n_vids"), F.count_distinct("patient").alias("n_patients"), F.count_distinct("modality").alias("n_modalities")
    )
    return seen.where((F.col("n_vids") != 4) | (F.col("n_patients") != 2) | (F.col("n_modalities") != 2))


def fixed_moving(entities: DataFrame, fixed: str, moving: str, key: str = "patient") -> DataFrame:
    """pair_id, fix_vid, mov_vid where a key has exactly one entity of either modality; others are left out."""
    upper = F.upper(F.col("modality"))
    one = lambda name: F.min(F.when(upper == name.upper(), F.col("vid")))
    many = lambda name: F.count(F.when(upper == name.upper(), 1))
    per_key = entities.groupBy(key).agg(one(fixed).alias("fix_vid"), one(moving).alias("mov_vid"), many(fixed).alias("_nf"), many(moving).alias("_nm"))
    return per_key.where("_nf = 1 AND _nm = 1").select(F.col(key).cast("string").alias("pair_id"), "fix_vid", "mov_vid")


def swapped_neighbours(samples: DataFrame) -> DataFrame:
    """Reverse each two samples in a row: partner is the other one of (0,1), (2,3), ... in the order of samples(sample)."""
    rows = ordered(samples, ["sample"], "pos")
    other = rows.select((F.col("pos") + 1 - 2 * (F.col("pos") % 2)).alias("pos"), F.col("sample").alias("partner"))
    return rows.join(other, "pos").select("pos", "sample", "partner")
