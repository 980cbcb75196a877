"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A row descends region, rack and shard. Each rack is an axis on which its shards lie one after the other, each as long as its weight, and
for every key a random process drops points on the axis: the first one to fall on a shard of the rack is the rack's draw, its time, and
the shard it falls on is where a row that comes to this rack goes. A region draws the least of its racks' times, and at each level
the least draw wins. Times are exponential with the summed weight of a subtree as their rate, so children get rows in proportion to it.

* Only a rack's summed weight changes its draw. Weights that change within a rack, the sum unchanged, move rows within that rack only; a
  sum that changes moves rows into or out of that rack and no row between two others.
* A shard added at a rack's end, or in a new rack or region, takes rows only into itself, at every count (the law `key`).

The process isn't made point by point: an axis is cut into blocks of 1, 1, 2, 4, ... units, each with one draw for its first point. A block's
half that has the point is a bit of a hash, and the other half's first point comes an exponential time later. So a rack needs one hash
for each power of two of its weight, and one for each halving of the last block, instead of one for each shard, and the winner alone
is followed down to its shard. Weights are kept to 1/4096.

Defined results: a null key is a key like any other; repeated keys share a shard; a null text has 16 bytes; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task numbers; a shard is dealt to as many buckets as that needs.
BUCKET_ROWS = 20_000
#: The buckets' first slots are broadcast up to this many rows, and joined by shuffle beyond.
BROADCAST_ROWS = 200_000
#: Parts of a unit of weight that are told apart: a power of two.
GRAINS = 4096

_LEAF = "struct<rack:int,end:bigint,shard:int>"


def topology(shards: int, racks: int = 2, rack_shards: int = 4, weights: dict[int, float] | None = None) -> list[dict]:
    """Regions of racks of shards, filled in order."""
    leaf = lambda s: {"name": f"s{s}", "weight": float((weights or {}).get(s, 1.0)), "shard": s}
    group = lambda first, end: {"name": f"k{first}", "shards": [leaf(s) for s in range(first, end)]}
    own = racks * rack_shards
    return [
        {"name": f"r{at}", "racks": [group(first, min(first + rack_shards, shards)) for first in range(at, min(at + own, shards), rack_shards)]}
        for at in range(0, shards, own)
    ]


def grains(weight: float) -> int:
    found = round(weight * GRAINS)
    if found < 1:
        raise ValueError(f"a weight is at least {1 / GRAINS}, not {weight}")
    return found


def _node(rack: Column, start: Column, size: Column, key: Column) -> Column:
    """The hash of a block of a rack's axis and a key: its upper bits are a draw, its last bit names a half."""
    return F.xxhash64(rack, start, size, key)


def _wait(node: Column, size: int) -> Column:
    """An exponential time for a block of so many grains."""
    u = (F.shiftrightunsigned(node, 11).cast("double") + 0.5) / F.lit(2.0**53)
    return -F.ln(u) * F.lit(GRAINS / size)


def _blocks(name: str, total: int, key: Column) -> list[tuple[Column, int, int]]:
    """The time of the first point, start and size of blocks that make up the first `total` grains of a rack's axis."""
    out: list[tuple[Column, int, int]] = []
    node = lambda start, size: _node(F.lit(name), F.lit(start).cast("long"), F.lit(size).cast("long"), key)
    start, size = 0, GRAINS
    while start < total:
        # a block's draw is its node's hash in the doubled numbering, so that it isn't the one that halves it
        time = _wait(_node(F.lit(f"{name}!"), F.lit(start).cast("long"), F.lit(size).cast("long"), key), size)
        at, left = start, size
        while at < total and at + left > total:
            left //= 2
            half = node(at, 2 * left)
            later, in_right = _wait(half, left), F.pmod(half, F.lit(2)) == 1
            if at + left <= total:
                out.append((time + F.when(in_right, later).otherwise(0.0), at, left))
                time, at = time + F.when(in_right, 0.0).otherwise(later), at + left
            else:
                time = time + F.when(in_right, later).otherwise(0.0)
        if at < total:
            out.append((time, at, left))
        start, size = start + size, start + size
    return out


def winner_of(key: Column, tree: list[dict]) -> Column:
    """struct(draw, rack, start, size): the rack that a key descends to, region by region, and the block of its axis in which the rack's first
    point falls; racks are counted from 0 through all regions. Weights are at least 1 / GRAINS."""
    regions, number = [], 0
    for region in tree:
        racks = []
        for rack in region["racks"]:
            total = sum(grains(x["weight"]) for x in rack["shards"])
            blocks = [F.struct(t.alias("draw"), F.lit(number).alias("rack"), F.lit(a).cast("long").alias("start"), F.lit(n).cast("long").alias("size")) for t, a, n in _blocks(rack["name"], total, key)]
            racks.append(F.array_min(F.array(*blocks)))
            number += 1
        regions.append(F.array_min(F.array(*racks)))
    return F.array_min(F.array(*regions))


def shard_of(key: Column, tree: list[dict]) -> Column:
    """The shard that a key descends to: the winning rack's first point is followed to the shard under it."""
    leaves, names, finest, longest = [], [], GRAINS, 1
    for region in tree:
        for rack in region["racks"]:
            end = 0
            for leaf in rack["shards"]:
                end += grains(leaf["weight"])
                leaves.append({"rack": len(names), "end": end, "shard": leaf["shard"]})
                finest = min(finest, end & -end)
            names.append(rack["name"])
            longest = max(longest, end)
    table = F.from_json(F.lit(json.dumps(leaves)), f"array<{_LEAF}>")
    halvings = max((longest - 1).bit_length() - (finest.bit_length() - 1), 0)

    def followed(won: Column) -> Column:
        rack = F.element_at(F.array(*map(F.lit, names)), won["rack"] + 1)

        def halved(block: Column) -> Column:
            half = F.floor(block["size"] / 2)
            bit = F.pmod(_node(rack, block["start"], block["size"], key), F.lit(2))
            return F.struct((block["start"] + bit * half).alias("start"), half.alias("size"))

        first = F.struct(won["start"].alias("start"), won["size"].alias("size"))
        place = F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), first, lambda b, _: F.when(b["size"] > finest, halved(b)).otherwise(b)) if halvings else first
        return F.element_at(F.filter(table, lambda x: (x["rack"] == won["rack"]) & (x["end"] > place["start"])), 1)["shard"]

    return F.element_at(F.transform(F.array(winner_of(key, tree)), followed), 1)


def with_slots(rows: DataFrame, shard: str, key: str, ties: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add slot, gapless from 0 in each shard: in the order of a bucket (a hash of key and ties, so that
    repeats of a key spread), then of key and ties."""
    shards, largest = rows.groupBy(shard).count().agg(F.count(F.lit(1)), F.coalesce(F.max("count"), F.lit(0))).first()
    buckets = max(1, -(-largest // bucket_rows))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(key, *ties), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(shard, "_bucket").count()
    starts = starts.select(shard, "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    if buckets * shards <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    within = Window.partitionBy(shard, "_bucket").orderBy(*[F.col(c).asc_nulls_last() for c in [key, *ties]])
    numbered = rows.withColumn("_at", F.row_number().over(within) - 1).join(starts, [shard, "_bucket"])
    return numbered.withColumn("slot", F.col("_start") + F.col("_at")).drop("_bucket", "_at", "_start")


def assign(docs: DataFrame, shards: int = 40) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), topology(shards)).alias("shard"),
        shard_of(F.col("doc_id"), topology(shards + 1)).alias("grown_shard"),
    )
    columns = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    return with_slots(rows, "shard", "doc_id", ["text_crc32", "size"]).select(*columns)
