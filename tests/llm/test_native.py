"""Exact dedup, sharding and mixing against plain Python, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import CLASHING, SCHEMA, rows_of
from voxlake.llm import exact_dedup, mixing, sharding

SPACES = re.compile(r"[\x20\x09-\x0D]")


def expected_groups(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[SPACES.sub("", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for norm, members in groups.items():
        members.sort(key=lambda m: m[:3])
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(m[3], members[0][3], len(members), k == 0, sha) for k, m in enumerate(members)]
    return out


@pytest.mark.parametrize("hot_rows", [1, 2, 1000])
def test_exact_groups(spark, odd, odd_rows, hot_rows):
    found = exact_dedup.decisions(odd, hot_rows)
    key = lambda r: str(r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(expected_groups(odd_rows), key=key)


@pytest.mark.parametrize("hot_rows", [1, 1000])
def test_exact_dedup_keeps_one_of_each(odd, odd_rows, hot_rows):
    kept = exact_dedup.deduplicate(odd, hot_rows)
    assert kept.columns == odd.columns
    texts = [SPACES.sub("", r["text"] or "") for r in kept.collect()]
    assert Counter(texts) == Counter({SPACES.sub("", r[1] or "") for r in odd_rows})
    assert all(r[c] == "own" for r in kept.collect() for c in CLASHING)


def test_exact_dedup_matches_sf(docs):
    key = lambda r: str(r)
    rows = [tuple(r) for r in docs.collect()]
    assert sorted(map(tuple, exact_dedup.decisions(docs, 3).collect()), key=key) == sorted(expected_groups(rows), key=key)


def test_exact_dedup_hot_group(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot  text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    found = exact_dedup.decisions(rows, 100)
    hot = found.where("group_size > 1").agg(F.count("*"), F.min("keep_id"), F.max("keep_id"), F.sum(F.col("kept").cast("int")), F.min("group_size")).first()
    assert tuple(hot) == (1667, 0, 0, 1, 1667)


def test_empty_tables(empty):
    assert exact_dedup.decisions(empty).collect() == []
    assert exact_dedup.deduplicate(empty).collect() == []
    assert sharding.assign(empty).collect() == []
    assert mixing.mix(empty).collect() == []
    assert mixing.resample(empty).collect() == []


def test_shards(odd, odd_rows, docs):
    for frame, rows in ((odd, odd_rows), (docs, [tuple(r) for r in docs.collect()])):
        found = sharding.assign(frame).collect()
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
        slots = defaultdict(list)
        for r in found:
            slots[r["shard"]].append(r["slot"])
            assert 0 <= r["shard"] < 40 and r["law"] == "key" and r["grown_shard"] in (r["shard"], 40)
        assert all(sorted(s) == [*range(len(s))] for s in slots.values())
        by_key = defaultdict(set)
        for r in found:
            by_key[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        assert all(len(v) == 1 for v in by_key.values())


def test_shards_are_even_and_follow_weights(spark):
    ids = spark.range(40_000)
    counts = Counter(r[0] for r in ids.select(sharding.shard_of(F.col("id"), sharding.topology(40))).collect())
    assert len(counts) == 40 and 800 < min(counts.values()) and max(counts.values()) < 1200
    heavier = sharding.topology(40, weights={7: 3.0})
    moved = ids.select(sharding.shard_of(F.col("id"), sharding.topology(40)).alias("a"), sharding.shard_of(F.col("id"), heavier).alias("b")).where("a <> b")
    # all movement is into the heavier shard
    assert {r["b"] for r in moved.select("b").distinct().collect()} == {7}


@pytest.mark.parametrize("shards", [1, 4, 7, 8, 10, 39, 40, 41])
def test_one_shard_more_takes_rows_only_into_itself(spark, shards):
    ids = spark.range(5000)
    both = ids.select(*[sharding.shard_of(F.col("id"), sharding.topology(n)).alias(x) for n, x in ((shards, "a"), (shards + 1, "b"))])
    moved = both.where("a <> b").groupBy("b").count().collect()
    assert [r["b"] for r in moved] == [shards] and abs(moved[0]["count"] - 5000 / (shards + 1)) < 5 * (5000 / (shards + 1)) ** 0.5


def chained(*parts):
    """Spark's xxhash64 of strings and longs: each seeds the next."""
    seed = 42
    for x in parts:
        seed = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else x.to_bytes(8, "little", signed=True), seed)
    return seed


def first_points(rack, key, total, finest):
    """The time of the first point of every smallest block of a rack's axis, halving by halving."""
    wait = lambda h, size: -math.log(((h >> 11) + 0.5) / 2.0**53) * 4096 / size
    out = {}

    def halve(start, size, time):
        if size == finest:
            out[start] = time
            return
        h = chained(rack, start, size, key)
        later = time + wait(h, size // 2)
        halve(start, size // 2, time if h % 2 == 0 else later)
        halve(start + size // 2, size // 2, later if h % 2 == 0 else time)

    start, size = 0, 4096
    while start < total:
        halve(start, size, wait(chained(f"{rack}!", start, size, key), size))
        start = size = start + size
    return {at: t for at, t in out.items() if at < total}


@pytest.mark.parametrize("weights", [{}, {3: 2.5, 20: 0.5}, {0: 0.5, 1: 1.5, 9: 7.0, 20: 1.5}])
def test_descent_of_the_tree(spark, weights):
    """Region by region, rack by rack: the shard under the first of all points of the rack with the first one."""
    tree = sharding.topology(21, weights=weights)
    rows = spark.range(300).select("id", sharding.shard_of(F.col("id"), tree).alias("found")).collect()
    for row in rows:
        def draw(rack, key=row["id"]):
            points = first_points(rack["name"], key, sum(int(x["weight"] * 4096) for x in rack["shards"]), 2048)
            return min((t, at) for at, t in points.items())

        region = min(tree, key=lambda r: min(map(draw, r["racks"])))
        rack = min(region["racks"], key=draw)
        at, end = draw(rack)[1], 0
        for leaf in rack["shards"]:
            end += int(leaf["weight"] * 4096)
            if at < end:
                break
        assert leaf["shard"] == row["found"]


@pytest.mark.parametrize("weights", [{0: 1.8, 1: 0.2}, {16: 0.25, 17: 0.25, 18: 2.5}, {36: 3.75, 37: 0.125, 38: 0.0625, 39: 0.0625}])
def test_equal_sums_move_nothing_out_of_a_rack(spark, weights):
    before, after = (sharding.shard_of(F.col("id"), sharding.topology(40, weights=w)) for w in ({}, weights))
    moved = spark.range(40_000).select(before.alias("a"), after.alias("b")).cache()
    first = min(weights) // 4 * 4
    assert moved.where("a <> b").count() > 300
    assert moved.where(f"a <> b AND NOT (a BETWEEN {first} AND {first + 3} AND b BETWEEN {first} AND {first + 3})").count() == 0
    found = {r["b"]: r["count"] for r in moved.groupBy("b").count().collect()}
    assert all(abs(found.get(s, 0) - 1000 * w) < 5 * (1000 * w) ** 0.5 + 5 for s, w in weights.items())
    moved.unpersist()


@pytest.mark.parametrize(("weights", "share"), [({5: 2.5, 6: 0.25}, 4.75), ({12: 0.125}, 3.125), ({37: 9.0}, 12.0)])
def test_other_sums_move_nothing_between_other_racks(spark, weights, share):
    before, after = (sharding.shard_of(F.col("id"), sharding.topology(40, weights=w)) for w in ({}, weights))
    moved = spark.range(40_000).select(before.alias("a"), after.alias("b"))
    own = min(weights) // 4
    assert moved.where(f"a <> b AND a div 4 <> {own} AND b div 4 <> {own}").count() == 0
    want = 40_000 * share / (36 + share)
    assert abs(moved.where(f"b div 4 = {own}").count() - want) < 5 * want**0.5


def test_weights_have_a_least_part():
    with pytest.raises(ValueError, match="at least"):
        sharding.shard_of(F.lit(1), sharding.topology(3, weights={1: 1e-6}))


def test_slots_over_many_buckets(spark):
    rows = spark.range(3000).select((F.col("id") % 2).alias("shard"), F.col("id").alias("k"))
    found = sharding.with_slots(rows, "shard", "k", [], bucket_rows=100)
    assert found.groupBy("shard").agg(F.min("slot"), F.max("slot"), F.count_distinct("slot")).orderBy("shard").collect() == [(0, 0, 1499, 1500), (1, 0, 1499, 1500)]


def water_filled(sizes: dict, weights=(1.0, 2.0, 3.0), cap=3.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(capped.values())
        target = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if target[s] > cap * sizes[s] + 1e-9]
        if not over:
            return target | capped
        capped |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("block", [2, 64])
def test_mix(odd, odd_rows, docs, block):
    for frame, rows in ((odd, odd_rows), (docs, [tuple(r) for r in docs.collect()])):
        found = mixing.copies(frame, block=block).collect()
        words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes, largest = defaultdict(int), defaultdict(int)
        for _, text, _, source, _ in rows:
            sizes[source] += words(text)
            largest[source] = max(largest[source], words(text))
        target = water_filled(sizes)
        assert Counter((r["doc_id"], r["source"], r["size"]) for r in found) == Counter((r[0], r[3], words(r[1])) for r in rows)
        taken = defaultdict(int)
        for r in found:
            assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
            assert 0 <= r["copies"] <= 3 and (r["size"] or not r["copies"])
            taken[r["source"]] += r["size"] * r["copies"]
        assert all(abs(taken[s] - target[s]) <= largest[s] + 1e-6 for s in sizes)


def test_mix_reruns_agree_and_resample_follows(odd):
    first = rows_of(mixing.mix(odd))
    assert first == rows_of(mixing.mix(odd.repartition(7)))
    out = mixing.resample(odd)
    assert out.columns == odd.columns
    want = mixing.copies(odd).agg(F.sum("copies")).first()[0]
    assert out.count() == want and out.where("_row <> 'own'").count() == 0


def test_mix_of_repeated_rows(spark):
    """2,000 rows alike are one unit: they take what their source's target leaves them, within one copy."""
    rows = [(1, "one two three", "a")] * 2000 + [(k, "w " * (k % 5 + 1), "b") for k in range(2, 700)] + [(None, "x y", "c")] * 900
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    found = mixing.copies(frame, block=8)
    sums = found.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).collect()
    assert {r["source"]: r["rows"] for r in sums} == {"a": 2000, "b": 698, "c": 900}
    assert all(abs(r["taken"] - r["target"]) <= 5 and r["most"] <= 3 for r in sums)


def test_mix_rounding_keeps_chances(spark):
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("w"), (F.col("id") % 7 + 1).cast("int"))).alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    total = sum(mixing.copies(rows, seed=s).where("source = 'a'").agg(F.sum("copies")).first()[0] for s in range(3)) / 3
    one = mixing.copies(rows).where("source = 'a'").first()
    assert total == pytest.approx(100 * one["target"] / one["source_size"], rel=0.1)


def test_schema_of_fixture(odd):
    assert odd.columns[:5] == [c.split()[0] for c in SCHEMA.split(", ")]
