"""Registration metrics: Dice of warped labels, surface distances, and the spread of the log Jacobian."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.operators import warp
from voxlake.operators.distance import nearest
from voxlake.operators.grids import XYZ, shapes
from voxlake.operators.neighbourhood import line, surface

_AT = ["pair_id", *XYZ]


def _classes(fixed: DataFrame, moving: DataFrame) -> DataFrame:
    """pair_id, label (1 to the largest of either side), and whether both originals have it."""
    sides = fixed.select("pair_id", "seg", F.lit(1).alias("f"), F.lit(0).alias("m")).unionByName(moving.select("pair_id", "seg", F.lit(0).alias("f"), F.lit(1).alias("m")))
    seen = sides.groupBy("pair_id", "seg").agg(F.max("f").alias("f"), F.max("m").alias("m"))
    most = seen.groupBy("pair_id").agg(F.max("seg").alias("_max")).where("_max >= 1")
    wanted = most.select("pair_id", F.explode(F.expr("sequence(1, _max)")).alias("label"))
    both = seen.where("f = 1 AND m = 1").select("pair_id", F.col("seg").alias("label"), F.lit(True).alias("both"))
    return wanted.join(both, ["pair_id", "label"], "left").select("pair_id", "label", F.coalesce("both", F.lit(False)).alias("both"))


def dice(fixed: DataFrame, moving: DataFrame, warped: DataFrame) -> DataFrame:
    """pair_id, label, dice: null where a class is absent from either original. All are (pair_id, d, h, w, seg)."""
    met = fixed.join(warped.select(*_AT, F.col("seg").alias("_w")), _AT)
    sides = met.select("pair_id", F.explode(F.array(F.struct(F.col("seg").alias("label"), (F.col("seg") == F.col("_w")).cast("int").alias("hit")), F.struct(F.col("_w").alias("label"), F.lit(0).alias("hit")))).alias("x"))
    sums = sides.groupBy("pair_id", "x.label").agg(F.count(F.lit(1)).alias("n"), F.sum("x.hit").alias("hits"))
    found = _classes(fixed, moving).join(sums, ["pair_id", "label"], "left")
    return found.select("pair_id", "label", F.when(F.col("both"), 2.0 * F.col("hits") / F.col("n")).alias("dice"))


def directed_distances(a: DataFrame, b: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """pair_id, label, distance: for each point of a the distance to the nearest point of b (points: pair_id, label, d, h, w)."""
    return nearest(a, b, ["pair_id", "label"], spacing).select("pair_id", "label", "distance")


def hd95(fixed: DataFrame, moving: DataFrame, warped: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), mode: str = "pooled") -> DataFrame:
    """pair_id, label, hd95: the 95th percentile of surface distances in both directions ("pooled"), or the larger of both
    directed ones ("max_directed"); null where a class is absent."""
    wanted = _classes(fixed, moving)
    present = wanted.where("both").select("pair_id", "label")
    edge = lambda df: surface(df.select(*_AT, F.col("seg").alias("label")).join(present, ["pair_id", "label"]), ["pair_id", "label"])
    a, b = edge(fixed), edge(warped)
    both = directed_distances(a, b, spacing).withColumn("way", F.lit(0)).unionByName(directed_distances(b, a, spacing).withColumn("way", F.lit(1)))
    if mode == "pooled":
        found = both.groupBy("pair_id", "label").agg(F.percentile("distance", 0.95).alias("hd95"))
    else:
        found = both.groupBy("pair_id", "label", "way").agg(F.percentile("distance", 0.95).alias("p")).groupBy("pair_id", "label").agg(F.max("p").alias("hd95"))
    return wanted.join(found, ["pair_id", "label"], "left").select("pair_id", "label", "hd95")


def jacobian(field: DataFrame) -> DataFrame:
    """pair_id, d, h, w, det: the determinant of the identity plus the field's central differences; interior voxels only (two
    from every side)."""
    rows = field
    for c in XYZ:
        own = line(c, ["pair_id"])
        rows = rows.withColumns({f"g{i}{c}": (F.lead(f"u{v}").over(own) - F.lag(f"u{v}").over(own)) / 2 for i, v in enumerate(XYZ)})
    j = [[(1.0 if i == k else 0.0) + F.col(f"g{i}{c}") for k, c in enumerate(XYZ)] for i in range(3)]
    det = (
        j[0][0] * (j[1][1] * j[2][2] - j[1][2] * j[2][1])
        - j[1][0] * (j[0][1] * j[2][2] - j[0][2] * j[2][1])
        + j[2][0] * (j[0][1] * j[1][2] - j[0][2] * j[1][1])
    )
    sizes = shapes(field, ["pair_id"])
    inner = " AND ".join(f"{c} BETWEEN 2 AND n{c} - 3" for c in XYZ)
    return rows.join(sizes, "pair_id").where(inner).select(*_AT, det.alias("det"))


def log_jacobian_std(field: DataFrame, sample: bool = True) -> DataFrame:
    """pair_id, log_jac_det_std: the deviation of log(det + 3), at least 1e-9 inside; null for volumes without an interior."""
    value = F.ln(F.greatest(F.col("det") + 3.0, F.lit(1e-9)))
    std = (F.stddev_samp if sample else F.stddev_pop)(value).alias("log_jac_det_std")
    return field.select("pair_id").distinct().join(jacobian(field).groupBy("pair_id").agg(std), "pair_id", "left")


def evaluate(fixed: DataFrame, moving: DataFrame, fields: DataFrame, metrics: tuple[str, ...] = ("dice", "hd95", "log_jac_det_std")) -> DataFrame:
    """pair_id, displacement, metric, label (null: the pair's mean or single figure) and value, of every named displacement.
    fixed, moving: (pair_id, d, h, w, seg); fields: (pair_id, displacement, d, h, w, ud, uh, uw)."""
    names = fields.select("pair_id", "displacement").distinct()
    key = F.concat_ws("\t", "displacement", "pair_id")
    spread = lambda df: df.join(names, "pair_id").select(key.alias("pair_id"), *XYZ, "seg")
    f, m, u = spread(fixed), spread(moving), fields.withColumn("pair_id", key).drop("displacement")
    warped = warp.nearest(u, m, shapes(m, ["pair_id"]), "seg")
    out = None
    for metric in metrics:
        if metric == "log_jac_det_std":
            rows = log_jacobian_std(u).select("pair_id", F.lit(metric).alias("metric"), F.lit(None).cast("int").alias("label"), F.col(metric).alias("value"))
        else:
            per = {"dice": dice, "hd95": hd95}[metric](f, m, warped).select("pair_id", F.lit(metric).alias("metric"), F.col("label").cast("int").alias("label"), F.col(metric).alias("value"))
            means = per.groupBy("pair_id", "metric").agg(F.avg("value").alias("value")).select("pair_id", "metric", F.lit(None).cast("int").alias("label"), "value")
            rows = per.unionByName(means)
        out = rows if out is None else out.unionByName(rows)
    parts = F.split("pair_id", "\t", 2)
    return out.select(parts[1].alias("pair_id"), parts[0].alias("displacement"), "metric", "label", "value")
