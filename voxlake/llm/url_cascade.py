"""URL filters by a Bloom filter cascade.

A rule is a host and a path, as in `example.com/en/`: it fits that host and its subdomains where the url's path starts
with the rule's. Every url has a bounded number of candidate keys (host suffix and path beginning, as long as some rule's).
The cascade's first filter encodes the listed keys; the second those keys of the corpus's complete key universe that the
first takes for listed; the third the listed keys that the second takes for these; and so on until no false answer is
left. Membership is then exact for every key in the universe, and judging urls needs no join: the longest candidate that
the cascade holds is the rule. What each level encodes comes from a scan of all candidates; only bit arrays of a checked
size reach the driver and the executors. A list whose filters would be larger is cut by ranges of the keys' hashes: each range
has a cascade of its own, and one after the other judges the candidates in its range.

Defined results: a null url and one without `://` have empty host and path and no rule; repeated rows are judged alike; an
empty table or an empty list gives the default verdict or no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm.scratch import materialise

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: One filter's size; where a level needs more, the keys are cut into twice as many ranges.
MAX_FILTER_BYTES = 64 << 20
MAX_RANGES = 1 << 16
#: Rates of false positives of the first level and of the others.
FIRST_RATE, LATER_RATE = 0.001, 0.5
MAX_LEVELS = 64

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


class FilterTooLarge(Exception):
    """A level's bit array would exceed the bound."""


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    shape = "://([^/?#]*)([^?#]*)"
    get = lambda k: F.coalesce(F.regexp_extract(url, shape, k), F.lit(""))
    return F.translate(get(1), string.ascii_uppercase, string.ascii_lowercase), get(2)


def split_rule(rule: str) -> tuple[str, str]:
    at = rule.find("/")
    return (rule, "") if at < 0 else (rule[:at], rule[at:])


def candidates(host: Column, path: Column, rules: list[str]) -> Column:
    """Every key that could be a rule of these shapes, longest first."""
    depths = sorted({split_rule(r)[0].count(".") + 1 for r in rules}) or [1]
    lengths = sorted({len(split_rule(r)[1]) for r in rules}) or [0]
    # two literals, however many shapes the rules have
    listed = lambda values: F.from_json(F.lit(json.dumps(values)), "array<int>")
    labels = F.when(host != "", F.char_length(host) - F.char_length(F.replace(host, F.lit("."), F.lit(""))) + 1).otherwise(0)
    longest = F.filter(listed(lengths[::-1]), lambda n: n <= F.char_length(path))

    def keys(d: Column) -> Column:
        own = F.call_function("substring_index", host, F.lit("."), -d)
        return F.transform(longest, lambda n: F.concat(own, F.substring(path, F.lit(1), n)))

    found = F.flatten(F.transform(F.filter(listed(depths[::-1]), lambda d: d <= labels), keys))
    placed = F.transform(F.array_distinct(found), lambda key: F.struct(F.char_length(key).alias("n"), key.alias("key")))
    return F.transform(F.sort_array(placed, asc=False), lambda x: x["key"])


def hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@dataclass
class Level:
    bits: np.ndarray  # uint64
    hashes: int
    salt: int

    def positions(self, a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
        salt = np.uint64(self.salt * int(_STEP) & 0xFFFFFFFFFFFFFFFF)
        x, y = _mix(a.view(np.uint64) ^ salt), _mix(b.view(np.uint64) + salt) | np.uint64(1)
        for i in range(self.hashes):
            yield (x + np.uint64(i) * y) % np.uint64(self.bits.size * 64)

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = np.ones(len(a), bool)
        for at in self.positions(a, b):
            found &= (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def bloom(rows: DataFrame, number: int, rate: float, salt: int, max_bytes: int) -> Level:
    """The filter of rows(h1, h2), `number` of them; only words with a bit set travel."""
    bits = max(64, math.ceil(number * -math.log(rate) / math.log(2) ** 2))
    words = -(-bits // 64)
    if words * 8 > max_bytes:
        raise FilterTooLarge(f"{words * 8} bytes for {number} keys; the bound is {max_bytes}")
    empty = Level(np.zeros(words, np.uint64), max(1, round(-math.log2(rate))), salt)

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            at = np.unique(np.concatenate([*empty.positions(a, b)])) if len(a) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_pydict({"word": (at >> np.uint64(6)).astype(np.int64), "bits": np.left_shift(np.uint64(1), at & np.uint64(63)).view(np.int64)})

    for word, value in rows.select("h1", "h2").mapInArrow(set_bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits")).toLocalIterator():
        empty.bits[word] = np.uint64(value & 0xFFFFFFFFFFFFFFFF)
    return empty


def member(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact for keys of the universe: the number of levels passed in a row is odd for listed keys."""
    passed, inside = np.zeros(len(a), int), np.arange(len(a))
    for level in levels:
        inside = inside[level.holds(a[inside], b[inside])]
        passed[inside] += 1
    return passed % 2 == 1


def held(level: Level):
    @F.pandas_udf("boolean")
    def held(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(level.holds(a.to_numpy(np.int64), b.to_numpy(np.int64)))

    return held


def build(listed: DataFrame, universe: DataFrame, max_bytes: int = MAX_FILTER_BYTES) -> list[Level]:
    """The cascade of listed(key) against universe(key); repeats and nulls in either are allowed."""
    hashed = lambda df: df.where(F.col("key").isNotNull()).select("key", *[h.alias(f"h{k}") for k, h in enumerate(hashes(F.col("key")), 1)])
    inside = materialise(hashed(listed).distinct(), "cascade-listed")
    number = inside.count()
    if not number:
        return []
    levels = [bloom(inside, number, FIRST_RATE, 1, max_bytes)]
    taken = hashed(universe).where(held(levels[0])("h1", "h2")).withColumn("_in", F.lit(0))
    both = taken.unionByName(inside.withColumn("_in", F.lit(1))).groupBy("key", "h1", "h2").agg(F.max("_in").alias("_in"))
    outside = materialise(both.where("_in = 0").drop("_in"), "cascade-false")
    sides = [inside, outside]
    while number := sides[1].count():
        if len(levels) >= MAX_LEVELS:
            raise RuntimeError(f"{number} keys are still judged wrongly after {MAX_LEVELS} levels")
        level = bloom(sides[1], number, LATER_RATE, len(levels) + 1, max_bytes)
        levels.append(level)
        sides = [sides[1], materialise(sides[0].where(held(level)("h1", "h2")), "cascade-false")]
    return levels


def _first_listed(cascades: list[list[Level]]):
    @F.pandas_udf("struct<at:int,which:int>")
    def first(a: pd.Series, b: pd.Series, here: pd.Series) -> pd.DataFrame:
        sizes = a.map(len).to_numpy(np.int64)
        none, kinds = np.iinfo(np.int64).max, max(1, len(cascades))
        best = np.full(len(a), none)
        if sizes.sum():
            flat = [np.concatenate([np.asarray(x, np.int64) for x in s]) for s in (a, b)]
            row = np.repeat(np.arange(len(a)), sizes)
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            inside = np.concatenate([np.asarray(x, bool) for x in here])
            for which, levels in enumerate(cascades):
                listed = member(levels, *flat) & inside
                np.minimum.at(best, row[listed], place[listed] * kinds + which)
        found = best < none
        return pd.DataFrame({"at": np.where(found, best // kinds + 1, 0).astype(np.int32), "which": np.where(found, best % kinds, 0).astype(np.int32)})

    return first


def _range(key: Column, ranges: int) -> Column:
    """A key's range, of the upper bits of its hash."""
    return F.pmod(F.shiftright(hashes(key)[0], 40), F.lit(ranges))


def _found(rows: DataFrame, table: DataFrame, kinds: list[str], ranges: int, max_bytes: int) -> DataFrame:
    """rows with _found: the first of _keys that is listed (at, from 1; 0: none) and which of kinds lists it. With several ranges the
    answers of one are written before the next one's filters are made, so only one range's filters exist at a time."""
    rows = rows.withColumn("_found", F.lit(None).cast("struct<at:int,which:int>"))
    for number in range(ranges):
        here = lambda key: _range(key, ranges) == number  # noqa: B023, E731
        universe = rows.select(F.explode("_keys").alias("key")).where(here(F.col("key")))
        listed = lambda v: table.where((F.col("verdict") == v) & here(F.col("rule"))).select(F.col("rule").alias("key"))  # noqa: B023, E731
        cascades = [build(listed(v), universe, max_bytes) for v in kinds]
        of = lambda k: F.transform("_keys", lambda key: hashes(key)[k])
        rows = rows.withColumn("_now", _first_listed(cascades)(of(0), of(1), F.transform("_keys", here)))
        better = (F.col("_now.at") > 0) & (F.col("_found").isNull() | (F.col("_found.at") == 0) | (F.col("_now.at") < F.col("_found.at")))
        rows = rows.withColumn("_found", F.when(better, F.col("_now")).otherwise(F.coalesce("_found", "_now"))).drop("_now")
        if ranges > 1:
            rows = materialise(rows, "cascade-judged")
    return rows


def verdicts(pages: DataFrame, rules: list[tuple[str, str]] = RULES, default: str = "allow", max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """One row for each row of pages(page_id, url): page_id, host, path, rule (null: none), verdict."""
    spark: SparkSession = pages.sparkSession
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_keys", candidates(F.col("host"), F.col("path"), [r for r, _ in rules]))
    table = spark.createDataFrame(list(rules), "rule string, verdict string").dropDuplicates(["rule"])
    kinds = sorted({v for _, v in rules})
    ranges = 1
    while True:
        try:
            judged = _found(rows, table, kinds, ranges, max_bytes)
            break
        except FilterTooLarge:
            ranges *= 2
            if ranges > MAX_RANGES:
                raise
    some = F.col("_found.at") > 0
    names = F.array(*[F.lit(v) for v in kinds]) if kinds else F.array(F.lit(default))
    return judged.select(
        "page_id",
        "host",
        "path",
        F.when(some, F.try_element_at("_keys", F.col("_found.at"))).alias("rule"),
        F.when(some, F.element_at(names, F.col("_found.which") + 1)).otherwise(default).alias("verdict"),
    )


ORACLE_SQL = """
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM u
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
