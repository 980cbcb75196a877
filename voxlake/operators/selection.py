"""Exact order statistics by narrowing histograms: the k-th smallest values of large groups, in buffers that don't grow with them.

The first pass counts each group's values by octave (sign and power of two) and finds the octave of each rank. Further passes count
what is left in `BINS` equal parts between the least and the greatest value left, which are real values, so every pass separates
them; a double has 52 digits below its octave, so a few are enough. What is left of a rank goes to a window when it is at most
`SMALL` values. Bins are counted before the shuffle; from the second pass on only values in the bins of some rank are kept.
Logarithms, differences and quotients of doubles never change an order, so bins are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.scratch import dropped, written

#: Bins of a pass, values that a window sorts, and ranks that are broadcast (more are joined by shuffle).
BINS, SMALL, BROADCAST_RANKS = 4096, 1 << 17, 100_000
MAX_PASSES = 16


def _octave(x: Column) -> Column:
    """Sign and power of two, in the order of the values; then infinities and, last, NaN."""
    size = F.floor(F.log2(F.abs(x))).cast("int") + 1100  # above 0 for the smallest double
    ends = F.when(F.isnan(x), 20_000).when(x == float("inf"), 10_000).when(x == float("-inf"), -10_000)
    return ends.when(x == 0, 0).when(x > 0, size).otherwise(-size)


def _met(rows: DataFrame, ranks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with every rank of their group; null keys meet."""
    count = ranks.count()
    ranks = ranks.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(F.broadcast(ranks) if count <= BROADCAST_RANKS else ranks, on).drop(*[f"_{k}" for k in keys])


def _chosen(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of counts(keys, k, rank, bin, c, lo, hi) the bin in which each rank is, and the rank within it."""
    before = Window.partitionBy(*keys, "k").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = counts.withColumn("_end", F.sum("c").over(before)).withColumn("_start", F.col("_end") - F.col("c"))
    return rows.where("_start <= rank AND rank < _end").select(*keys, "k", (F.col("rank") - F.col("_start")).alias("rank"), "c", "lo", "hi")


_STATS = (F.count, F.min, F.max)


def _counted(groups, value: str) -> DataFrame:
    return groups.agg(*[f(value).alias(name) for f, name in zip(_STATS, ("c", "lo", "hi"), strict=True)])


def selected(rows: DataFrame, ranks: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """keys, k and x: the k-th smallest (from 0) of rows(keys, value) for every one of ranks(keys, k). Nulls don't count, NaN is the
    greatest; a rank beyond a group's count has no row; repeated values count as often as they occur."""
    names = {f: f"_g{i}" for i, f in enumerate(keys)}
    own = [*names.values()]
    rows = rows.where(F.col(value).isNotNull()).select(*[F.col(f).alias(g) for f, g in names.items()], F.col(value).cast("double").alias("v"))
    ranks = written(ranks.select(*[F.col(f).alias(g) for f, g in names.items()], F.col("k").cast("long").alias("k")).distinct(), "ranks")
    octaves = written(_counted(rows.groupBy(*own, _octave(F.col("v")).alias("bin")), "v"), "octaves")
    left = written(_chosen(_met(octaves, ranks.withColumn("rank", F.col("k")), own), own), "ranks")
    dropped(ranks, octaves)
    tables, found, held = [left], [], rows
    for _ in range(MAX_PASSES):
        same = F.col("lo").eqNullSafe(F.col("hi"))
        found.append(left.where(same).select(*own, "k", F.col("lo").alias("x")))
        small = left.where(~same & (F.col("c") <= SMALL))
        large = written(left.where(~same & (F.col("c") > SMALL)), "ranks")
        tables.append(large)
        own_k = ["k"] if "k" in held.columns else []
        if not small.isEmpty():
            within = _met(held, small, [*own, *own_k]).where("v >= lo AND v <= hi")
            place = F.row_number().over(Window.partitionBy(*own, "k").orderBy("v")) - 1
            found.append(within.withColumn("_at", place).where("_at = rank").select(*own, "k", F.col("v").alias("x")))
        if large.isEmpty():
            break
        within = _met(held, large, [*own, *own_k]).where("v >= lo AND v <= hi")
        part = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS).cast("int")
        left = written(_chosen(_counted(within.groupBy(*own, "k", "rank", part.alias("bin")), "v"), own), "ranks")
        narrowed = left.select(*own, "k", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
        held = written(_met(held, narrowed, [*own, *own_k]).where("v >= _lo AND v <= _hi").select(*own, "k", "v"), "narrowed")
        tables += [left, held]
    else:
        raise RuntimeError(f"{MAX_PASSES} passes don't separate the values")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    result = written(out.select(*[F.col(g).alias(f) for f, g in names.items()], "k", "x"), "selected")
    dropped(*tables)
    return result


def percentiles(rows: DataFrame, shares: Sequence[float], keys: Sequence[str], value: str = "value") -> DataFrame:
    """keys and p0, p1, ...: for each of shares (0 to 1) the percentile of each group's values, linear between ranks. Groups without
    values have no row."""
    sizes = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    sizes = written(sizes, "sizes")
    at = [(F.col("_n") - 1) * float(s) for s in shares]
    ends = F.array(*[f(a).cast("long") for a in at for f in (F.floor, F.ceil)])
    ranks = sizes.select(*keys, F.explode(F.array_distinct(ends)).alias("k"))
    found = selected(rows, ranks, keys, value)
    pairs = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", "x"))).alias("_x"))  # two for each share
    on = [sizes[k].eqNullSafe(pairs[k]) for k in keys]
    joined = sizes.join(pairs, on).select(*[sizes[k] for k in keys], "_n", "_x")
    out = []
    for i, a in enumerate(at):
        below, above = F.col("_x")[F.floor(a).cast("long")], F.col("_x")[F.ceil(a).cast("long")]
        mixed = (F.ceil(a) - a) * below + (a - F.floor(a)) * above
        out.append(F.when(below == above, below).otherwise(mixed).alias(f"p{i}"))
    return joined.select(*keys, *out)
