"""Label transfer by majority vote of the most similar key voxels, and its evaluation by Dice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.operators import similarity

KS = (1, 3, 5, 7, 9, 11)
EPS = 1e-8


def masked(voxels: DataFrame, mask: str | None = "msk") -> DataFrame:
    """Voxels inside the mask; a null mask is all true. A mask that isn't boolean is an error of types."""
    if mask is None:
        return voxels
    if dict(voxels.dtypes)[mask] != "boolean":
        raise TypeError(f"{mask} must be boolean, not {dict(voxels.dtypes)[mask]}")
    return voxels.where(F.coalesce(F.col(mask), F.lit(True)))


def label_counts(pairs: DataFrame, voxels: DataFrame) -> DataFrame:
    """pair_id and n_labels: the larger number of distinct labels of the two entities (of all voxels, not the largest label)."""
    seen = voxels.groupBy("vid").agg(F.count_distinct("seg").alias("n"))
    both = pairs.join(seen.select(F.col("vid").alias("query_vid"), F.col("n").alias("_nq")), "query_vid").join(
        seen.select(F.col("vid").alias("key_vid"), F.col("n").alias("_nk")), "key_vid"
    )
    return both.select("pair_id", F.greatest("_nq", "_nk").cast("int").alias("n_labels"))


def neighbours(pairs: DataFrame, voxels: DataFrame, k: int, metric: str = "cosine", n_labels: DataFrame | None = None) -> DataFrame:
    """pair_id, query_id, key_id, score, rank and label of the k keys nearest to each masked query voxel.
    voxels(vid, vox, feat, seg, msk); key voxels with labels outside 0 .. n_labels - 1 are dropped before the join."""
    inside = masked(voxels)
    queries = pairs.select("pair_id", F.col("query_vid").alias("vid")).join(inside, "vid").select("pair_id", F.col("vox").alias("query_id"), "feat")
    keys = pairs.select("pair_id", F.col("key_vid").alias("vid")).join(inside, "vid").select("pair_id", F.col("vox").alias("key_id"), "feat", F.col("seg").alias("label"))
    if n_labels is not None:
        keys = keys.join(n_labels, "pair_id").where("label BETWEEN 0 AND n_labels - 1").drop("n_labels")
    found = similarity.top_k(queries, keys.drop("label"), k, metric)
    return found.join(keys.select("pair_id", "key_id", "label"), ["pair_id", "key_id"])


def vote(found: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """pair_id, query_id, k, pred: the commonest label among the k nearest; ties go to the label of the best rank."""
    wanted = F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k")
    rows = found.select("pair_id", "query_id", "label", "rank", wanted).where("rank <= k")
    counts = rows.groupBy("pair_id", "query_id", "k", "label").agg(F.count(F.lit(1)).alias("votes"), F.min("rank").alias("first"))
    return counts.groupBy("pair_id", "query_id", "k").agg(F.max_by("label", F.struct("votes", -F.col("first"))).alias("pred"))


def running_votes(found: DataFrame) -> DataFrame:
    """How many of the ranks up to each have its label."""
    so_far = Window.partitionBy("pair_id", "query_id", "label").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return found.select("pair_id", "query_id", "rank", "label", F.count(F.lit(1)).over(so_far).alias("votes"))


def dice(predictions: DataFrame, truth: DataFrame, n_labels: DataFrame) -> DataFrame:
    """pair_id, k, label, dice for every label 0 .. n_labels - 1; a label that is absent on both sides has 0.
    predictions(pair_id, query_id, k, pred), truth(pair_id, query_id, seg)."""
    both = predictions.join(truth, ["pair_id", "query_id"]).select("pair_id", "k", "pred", "seg")
    sides = both.select("pair_id", "k", F.explode(F.array(F.struct(F.col("pred").alias("label"), (F.col("pred") == F.col("seg")).cast("int").alias("hit")), F.struct(F.col("seg").alias("label"), F.lit(0).alias("hit")))).alias("x"))
    sums = sides.groupBy("pair_id", "k", "x.label").agg(F.count(F.lit(1)).alias("n"), F.sum("x.hit").alias("hits"))
    wanted = both.select("pair_id", "k").distinct().join(n_labels, "pair_id").select("pair_id", "k", F.explode(F.expr("sequence(0, n_labels - 1)")).alias("label"))
    filled = wanted.join(sums, ["pair_id", "k", "label"], "left")
    score = 2.0 * F.coalesce("hits", F.lit(0)) / (F.coalesce("n", F.lit(0)) + F.lit(EPS))
    return filled.select("pair_id", "k", "label", score.alias("dice"))


def report(scores: DataFrame) -> DataFrame:
    """pair_id, k, dice_mean_fg: the mean over labels from 1 on, or label 0's value where there is no other."""
    front = F.avg(F.when(F.col("label") >= 1, F.col("dice")))
    return scores.groupBy("pair_id", "k").agg(F.coalesce(front, F.max(F.when(F.col("label") == 0, F.col("dice")))).alias("dice_mean_fg"))


def wide(scores: DataFrame, labels: Sequence[int]) -> DataFrame:
    """The report with a column for each label, as files have it."""
    columns = [F.max(F.when(F.col("label") == x, F.col("dice"))).alias(f"dice_{x}") for x in labels]
    return report(scores).join(scores.groupBy("pair_id", "k").agg(*columns), ["pair_id", "k"])


def summary(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, sample deviation, median, least and greatest value of each group."""
    v = F.col(value)
    return rows.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.median(v).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"))


def to_volume(predictions: DataFrame, voxels: DataFrame, pairs: DataFrame, background: int = 0, ks: Sequence[int] | None = None) -> DataFrame:
    """Every voxel of each query entity with its prediction; those outside the mask have the background label. ks: for every pair, where
    they are known; else those that a pair has predictions for, which are then made twice."""
    if ks is None:
        asked = pairs.join(predictions.select("pair_id", "k").distinct(), "pair_id")
    else:
        asked = pairs.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks])))
    grid = asked.select("pair_id", "k", F.col("query_vid").alias("vid")).join(voxels.select("vid", F.col("vox").alias("query_id"), "d", "h", "w"), "vid")
    placed = grid.join(predictions, ["pair_id", "k", "query_id"], "left")
    return placed.select("pair_id", "k", "d", "h", "w", F.coalesce("pred", F.lit(background)).cast("short").alias("label"))


def evaluate(pairs: DataFrame, voxels: DataFrame, ks: Sequence[int] = KS, metric: str = "cosine", n_labels: int | None = None) -> DataFrame:
    """pair_id, k, label, dice of every pair(pair_id, query_vid, key_vid)."""
    counts = pairs.select("pair_id", F.lit(n_labels).alias("n_labels")) if n_labels is not None else label_counts(pairs, voxels)
    predictions = vote(neighbours(pairs, voxels, max(ks), metric, counts), ks)
    truth = pairs.select("pair_id", F.col("query_vid").alias("vid")).join(masked(voxels), "vid").select("pair_id", F.col("vox").alias("query_id"), "seg")
    return dice(predictions, truth, counts)


def unravelled(flat: Column, rows: Column, cols: Column) -> tuple[Column, Column, Column]:
    """The coordinates of a flat index into a volume of so many rows and columns a plane."""
    within = F.pmod(flat, rows * cols)
    return F.floor(flat / (rows * cols)).cast("int"), F.floor(within / cols).cast("int"), F.pmod(within, cols).cast("int")


def voxel_id(d: str = "d", h: str = "h", w: str = "w") -> Column:
    """A long from three coordinates below 2^21."""
    return F.shiftleft(F.col(d).cast("long"), 42) + F.shiftleft(F.col(h).cast("long"), 21) + F.col(w).cast("long")
