"""Landmarks: centroids of labels, matching by two similarities, and summaries over ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlake.functions import vectors as V
from voxlake.operators import similarity

METRICS = {"cos": "cosine", "l2": "neg_sq_l2"}


def centroids(voxels: DataFrame) -> DataFrame:
    """vid, p, x, y, z: the mean place of each label but 0, rounded half to even."""
    means = voxels.where("seg <> 0").groupBy("vid", "seg").agg(*[F.rint(F.avg(c)).cast("int").alias(n) for c, n in (("d", "x"), ("h", "y"), ("w", "z"))])
    return means.select("vid", F.concat(F.lit("label_"), F.col("seg").cast("string")).alias("p"), "x", "y", "z")


def last_of_name(landmarks: DataFrame, order: str | None = None) -> DataFrame:
    """One landmark of each name of an entity: the last in the order of a column, or of places if there is none."""
    by = F.struct(*([order] if order else []), "x", "y", "z")
    last = landmarks.groupBy("vid", "p").agg(F.max_by(F.struct("x", "y", "z"), by).alias("_at"))
    return last.select("vid", "p", "_at.*")


def outside(landmarks: DataFrame, voxels: DataFrame) -> DataFrame:
    """Landmarks that no volume of theirs holds."""
    size = voxels.groupBy("vid").agg(*[(F.max(c) + 1).alias(f"_{c}") for c in "dhw"])
    held = (F.col("x") >= 0) & (F.col("x") < F.col("_d")) & (F.col("y") >= 0) & (F.col("y") < F.col("_h")) & (F.col("z") >= 0) & (F.col("z") < F.col("_w"))
    return landmarks.join(size, "vid", "left").where(~F.coalesce(held, F.lit(False))).select("vid", "p", "x", "y", "z")


def shared_names(pairs: DataFrame, landmarks: DataFrame, order: str | None = None) -> DataFrame:
    """pair_id, landmark, and both places, of names that both entities have; of a repeated name the last counts."""
    landmarks = last_of_name(landmarks, order)
    q = landmarks.select(F.col("vid").alias("query_vid"), "p", *[F.col(c).alias(f"q{c}") for c in "xyz"])
    k = landmarks.select(F.col("vid").alias("key_vid"), "p", *[F.col(c).alias(f"k{c}") for c in "xyz"])
    return pairs.join(q, "query_vid").join(k, ["key_vid", "p"]).withColumnRenamed("p", "landmark")


def match(pairs: DataFrame, voxels: DataFrame, landmarks: DataFrame, k: int) -> DataFrame:
    """pair_id, landmark, metric, rank, distance_vox: how far the k voxels most similar to a landmark of the query entity
    are from the key entity's landmark of that name. In a pair of an entity with itself the landmark's own voxel is no
    match. pairs(pair_id, query_vid, key_vid), voxels(vid, vox, d, h, w, feat); masks play no part."""
    shared = shared_names(pairs, landmarks)
    asked = shared.join(voxels.select(F.col("vid").alias("query_vid"), F.col("d").alias("qx"), F.col("h").alias("qy"), F.col("w").alias("qz"), "vox", "feat"), ["query_vid", "qx", "qy", "qz"])
    # a query of the similarity join is one landmark of one pair
    asked = asked.withColumn("query_id", F.xxhash64("landmark"))
    keys = pairs.select("pair_id", F.col("key_vid").alias("vid")).join(voxels, "vid").select("pair_id", F.col("vox").alias("key_id"), "feat", "d", "h", "w")
    found = None
    for name, metric in METRICS.items():
        part = similarity.top_k(asked.select("pair_id", "query_id", "feat"), keys.select("pair_id", "key_id", "feat"), k + 1, metric).withColumn("metric", F.lit(name))
        found = part if found is None else found.unionByName(part)
    places = asked.select("pair_id", "query_id", "landmark", "vox", (F.col("query_vid") == F.col("key_vid")).alias("self"), "kx", "ky", "kz")
    rows = found.join(places, ["pair_id", "query_id"]).where(~(F.col("self") & (F.col("key_id") == F.col("vox"))))
    order = Window.partitionBy("pair_id", "landmark", "metric").orderBy("rank")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    rows = rows.join(keys.select("pair_id", "key_id", "d", "h", "w"), ["pair_id", "key_id"])
    far = V.distance3((F.col("d"), F.col("h"), F.col("w")), (F.col("kx"), F.col("ky"), F.col("kz")))
    return rows.select("pair_id", "landmark", "metric", "rank", far.alias("distance_vox"))


def per_pair(raw: DataFrame, ks: Sequence[int], keys: Sequence[str] = ("pair_id", "landmark", "metric")) -> DataFrame:
    """Mean and population deviation of the distances at ranks 1 .. k, for each k that has as many ranks."""
    rows = raw.select(*keys, "rank", "distance_vox", F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k")).where("rank <= k")
    out = rows.groupBy(*keys, "k").agg(F.avg("distance_vox").alias("mean_topk"), F.stddev_pop("distance_vox").alias("std_topk"), F.count(F.lit(1)).alias("_n"))
    return out.where("_n = k").drop("_n")


def running(raw: DataFrame, ks: Sequence[int], keys: Sequence[str] = ("pair_id", "landmark", "metric")) -> DataFrame:
    """The same figures by one pass of a running window."""
    so_far = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = raw.select(*keys, F.col("rank").alias("k"), F.avg("distance_vox").over(so_far).alias("mean_topk"), F.stddev_pop("distance_vox").over(so_far).alias("std_topk"))
    return rows.where(F.col("k").isin(*map(int, ks)))


def summary(pair_rows: DataFrame, keys: Sequence[str] = ("seg_type", "metric", "k")) -> DataFrame:
    v = F.col("mean_topk")
    return pair_rows.groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.median(v).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n")
    )
