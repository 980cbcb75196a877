"""Places and running sums in the order of a whole table, without one task that sees all rows.

Rows are range-partitioned by the order; each part is numbered by itself, and what the parts before it hold, one row a part, is added.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.scratch import written


def ordered(rows: DataFrame, order: Sequence[str], place: str = "place", before: Mapping[str, Column] | None = None) -> DataFrame:
    """rows with `place`, from 0 in the order of columns, and for each of before the sum of an expression over the rows ahead. Rows alike in
    the order come in any order, next to each other; nulls come first; an empty table stays empty."""
    before = dict(before or {})
    dealt = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt.withColumns({f"_x{k}": x for k, x in enumerate(before.values())}), "ordered")
    sums = {"_n": F.count(F.lit(1))} | {f"_s{k}": F.sum(f"_x{k}") for k in range(len(before))}
    parts = dealt.groupBy("_part").agg(*[x.alias(n) for n, x in sums.items()])
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    starts = parts.select("_part", *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"_before{n}") for n in sums])
    own = Window.partitionBy("_part").orderBy(*order)
    running = own.rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(starts), "_part")
    columns = {place: F.row_number().over(own) - 1 + F.col("_before_n")}
    columns |= {name: F.coalesce(F.sum(f"_x{k}").over(running), F.lit(0)) + F.col(f"_before_s{k}") for k, name in enumerate(before)}
    return out.select(*[c for c in rows.columns if c not in columns], *[x.cast("long").alias(n) for n, x in columns.items()])
