"""Feature tables: joining axes, normalising channels, sampling tokens. One row is one voxel or token."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlake.functions import vectors as V

_AT = ["vid", "d", "h", "w"]


def _axes(x: DataFrame, y: DataFrame, z: DataFrame) -> DataFrame:
    parts = [df.select(*_AT, F.col("feat").alias(f"f{n}")) for n, df in zip("xyz", (x, y, z), strict=True)]
    return parts[0].join(parts[1], _AT).join(parts[2], _AT)


def concatenated(x: DataFrame, y: DataFrame, z: DataFrame) -> DataFrame:
    """Channels of the three axes in a row. All three joins are on one key, so each table is shuffled once."""
    return _axes(x, y, z).select(*_AT, F.concat("fx", "fy", "fz").alias("feat"))


def summed(x: DataFrame, y: DataFrame, z: DataFrame) -> DataFrame:
    return _axes(x, y, z).select(*_AT, V.add(F.col("fx"), F.col("fy"), F.col("fz")).alias("feat"))


def unit_summed(x: DataFrame, y: DataFrame, z: DataFrame, eps: float = 1e-8) -> DataFrame:
    """The sum of unit vectors."""
    return _axes(x, y, z).select(*_AT, V.add(*[V.unit(F.col(f"f{n}"), eps) for n in "xyz"]).alias("feat"))


def normalised(rows: DataFrame, method: str, eps: float = 1e-8) -> DataFrame:
    """none; l2: each vector to length 1; mm: all components of a volume to [0, 1]; dl2: each channel over the volume to
    length 1, then each vector."""
    if method == "none":
        return rows
    if method == "l2":
        return rows.withColumn("feat", V.unit(F.col("feat"), eps))
    if method == "mm":
        ends = rows.groupBy("vid").agg(F.min(F.array_min("feat")).alias("_a"), F.max(F.array_max("feat")).alias("_b"))
        scaled = F.transform("feat", lambda v: (v - F.col("_a")) / (F.col("_b") - F.col("_a") + eps))
        return rows.join(ends, "vid").withColumn("feat", scaled).drop("_a", "_b")
    if method == "dl2":
        squares = rows.select("vid", F.posexplode("feat").alias("c", "v")).groupBy("vid", "c").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
        norms = squares.groupBy("vid").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "n"))), lambda s: s["n"]).alias("_n"))
        channel = F.zip_with("feat", "_n", lambda v, n: v / (n + eps))
        return rows.join(norms, "vid").withColumn("feat", channel).drop("_n").withColumn("feat", V.unit(F.col("feat"), eps))
    raise ValueError(f"{method!r} is none of none, l2, mm, dl2")


def widened(rows: DataFrame, more: DataFrame, factor: float, chosen=None, unit: bool = False) -> DataFrame:
    """Chosen channels, of length 1 if wanted, times a factor, followed by the channels of another table."""
    feat = chosen(F.col("feat")) if chosen else F.col("feat")
    feat = V.scale(V.unit(feat) if unit else feat, factor)
    other = more.select(*_AT, F.col("feat").alias("_more"))
    return rows.join(other, _AT).select(*_AT, F.concat(feat, "_more").alias("feat"))


def masked(rows: DataFrame) -> DataFrame:
    """rows(..., feat, msk) with zeros for the features outside the mask; a null mask is all true."""
    return rows.withColumn("feat", F.when(F.coalesce("msk", F.lit(True)), F.col("feat")).otherwise(V.scale(F.col("feat"), 0.0)))


def hash_order(seed: int, *keys: str) -> F.Column:
    """A draw for each row that any engine can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *keys))


def every_token(tokens: DataFrame, masked: bool = False) -> DataFrame:
    """vid, slice_idx, tok_y, tok_x of all tokens, or of those whose msk is true (null: no mask, so all are)."""
    kept = tokens.where(F.coalesce("msk", F.lit(True))) if masked else tokens
    return kept.select("vid", "slice_idx", "tok_y", "tok_x")


def sampled(tokens: DataFrame, per_slice: int | None, total: int | None, seed: int = 0, keys: tuple[str, ...] = ("vid", "slice_idx", "tok_y", "tok_x")) -> DataFrame:
    """At most per_slice tokens of each slice and then at most total, by seeded hashes, without replacement. Both limits run
    before their shuffle as group and top-k limits; the total is a feature of this sampler, a bound the caller states."""
    rows = tokens.withColumn("_draw", hash_order(seed, *keys))
    if per_slice is not None:
        own = Window.partitionBy(*keys[:2]).orderBy("_draw", *keys)
        rows = rows.withColumn("_nth", F.row_number().over(own)).where(F.col("_nth") <= per_slice).drop("_nth")
    if total is not None:
        rows = rows.orderBy("_draw", *keys).limit(total)
    return rows.drop("_draw")


def planned(tokens: DataFrame, plan: DataFrame, keys: tuple[str, ...] = ("vid", "slice_idx", "tok_y", "tok_x")) -> DataFrame:
    """The tokens that a plan names."""
    return tokens.join(plan.select(*keys).distinct(), [*keys], "left_semi")


def fit_mask(rows: DataFrame, mode: str, data: str = "msk", generated: str = "msk_gen") -> DataFrame:
    """The mask to fit with, from a data mask and a generated one (null: all true): none, data, gen, inter or union."""
    a, b = (F.coalesce(F.col(c), F.lit(True)) for c in (data, generated))
    masks = {"none": F.lit(True), "data": a, "gen": b, "inter": a & b, "union": a | b}
    if mode not in masks:
        raise ValueError(f"{mode!r} is none of {[*masks]}")
    return rows.withColumn("msk_fit", masks[mode])


def foreground(rows: DataFrame, threshold: float = 0.99) -> DataFrame:
    """Voxels where not all channels exceed a threshold."""
    return rows.withColumn("msk_gen", ~F.forall("feat", lambda c: c > threshold))
