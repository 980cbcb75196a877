"""Exact dedup by content sort, in DataFrame functions only.

Texts are equal when identical after deleting white space (space and U+0009 to U+000D). Sampled splitters range-partition
the rows, an external sort places equal texts next to each other, and a window that compares each row's whole normalised
text with its neighbour's forms the groups. The splitters hold a short prefix and a hash of the bytes, never whole texts,
so what the sampling sends to the driver doesn't grow with the length of texts, and texts with one common beginning still
spread. A text with more than `hot_rows` copies is dealt to several partitions by a salt, and the salted parts are put
together in a second, small round over one row for each part.

Defined results: a null text counts as empty; null ids sort after all others; repeated rows are copies, and exactly one
row of a group stays even if ids repeat; an empty table gives an empty result; other columns are ignored by `decisions`
and returned untouched by `deduplicate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.llm.scratch import materialise

#: A group above this many rows is split; the sort then has at most about this many equal rows in one place.
HOT_ROWS = 1000
#: The list of split groups is broadcast up to this many rows (24 bytes each), and joined by shuffle beyond.
BROADCAST_ROWS = 200_000
#: Characters of the normalised text that the range splitters hold.
PREFIX = 16

_SPACES = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _SPACES, "")


def _hot_parts(docs: DataFrame, hot_rows: int) -> DataFrame:
    """_hash and _parts of every text hash with more than hot_rows rows; map-side counts come before the shuffle."""
    hashes = docs.select(F.xxhash64(normalised(F.col("text"))).alias("_hash"))
    counts = hashes.groupBy("_hash").count().where(F.col("count") > hot_rows)
    parts = materialise(counts.select("_hash", F.ceil(F.col("count") / hot_rows).cast("int").alias("_parts")), "hot-texts")
    return F.broadcast(parts) if parts.count() <= BROADCAST_ROWS else parts


def _sorted_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Range-partition by keys, sort, and number the rows of each run of equal texts: the longest original first."""
    own = Window.partitionBy(*keys, "_norm").orderBy(F.col("_length").desc(), F.col("doc_id").asc_nulls_last())
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.repartitionByRange(*keys).select(
        "*",
        F.row_number().over(own).alias("_rank"),
        F.first("doc_id").over(whole).alias("_keep"),
        F.first("_length").over(whole).alias("_keep_length"),
        F.count(F.lit(1)).over(whole).alias("_rows"),
    )


def _keyed(docs: DataFrame, parts: DataFrame, columns: list) -> DataFrame:
    norm = normalised(F.col("text"))
    rows = docs.select("doc_id", *columns, norm.alias("_norm"), F.char_length(F.coalesce(F.col("text"), F.lit(""))).alias("_length"))
    rows = rows.withColumns({"_prefix": F.substring("_norm", 1, PREFIX), "_hash": F.xxhash64("_norm")})
    rows = rows.join(parts, "_hash", "left")
    salt = F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", "_length"), F.col("_parts"))).cast("int")
    return rows.withColumn("_salt", salt)


_KEYS = ["_prefix", "_hash", "_salt"]


def decisions(docs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    rows = _sorted_groups(_keyed(docs, _hot_parts(docs, hot_rows), []), _KEYS)
    head = F.when(F.col("_parts").isNotNull() & (F.col("_rank") == 1), F.col("_norm"))
    slim = rows.select("doc_id", F.sha2("_norm", 256).alias("text_sha256"), "_hash", "_salt", "_parts", "_rank", "_keep", "_keep_length", "_rows", head.alias("_head"))
    slim = materialise(slim, "exact-groups")
    single = slim.where(F.col("_parts").isNull()).select(
        "doc_id", F.col("_keep").alias("keep_id"), F.col("_rows").alias("group_size"), (F.col("_rank") == 1).alias("kept"), "text_sha256"
    )
    split = slim.where(F.col("_parts").isNotNull())
    best = Window.partitionBy("_hash", "_head").orderBy(F.col("_keep_length").desc(), F.col("_keep").asc_nulls_last(), "_salt")
    whole = best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    merged = split.where(F.col("_rank") == 1).select(
        "text_sha256",
        "_salt",
        F.first("_keep").over(whole).alias("keep_id"),
        F.sum("_rows").over(whole).alias("group_size"),
        (F.row_number().over(best) == 1).alias("_first"),
    )
    joined = split.drop("_keep", "_keep_length", "_rows", "_head").join(merged, ["text_sha256", "_salt"])
    return single.unionByName(joined.select("doc_id", "keep_id", "group_size", (F.col("_first") & (F.col("_rank") == 1)).alias("kept"), "text_sha256"))


def deduplicate(docs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each group of equal texts."""
    parts = _hot_parts(docs, hot_rows)
    names = docs.columns
    rows = _keyed(docs, parts, [F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")])
    single = _sorted_groups(rows.where(F.col("_parts").isNull()), _KEYS).where(F.col("_rank") == 1)
    split = _sorted_groups(rows.where(F.col("_parts").isNotNull()), _KEYS).where(F.col("_rank") == 1)
    split = split.drop("_rank", "_keep", "_keep_length", "_rows")
    again = _sorted_groups(split, ["_prefix", "_hash"]).where(F.col("_rank") == 1)
    return single.select("_row").unionByName(again.select("_row")).select("_row.*")


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), w AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST) = 1 AS kept
  FROM t
)
SELECT doc_id, keep_id, group_size, kept, sha256(norm) AS text_sha256 FROM w
"""
