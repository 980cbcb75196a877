"""Entity keys: `s{sample}__m{MODALITY}__i{ID}`, and slice keys with an axis, an index and an end mark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR, END = "__", "<end>"


def _part(value: Column, what: str) -> Column:
    clean = F.upper(F.trim(value))
    good = F.coalesce(~F.contains(clean, F.lit(SEPARATOR)), F.lit(True))
    return F.when(good, clean).otherwise(F.raise_error(F.concat(F.lit(f"{what} must not hold {SEPARATOR}: "), clean)))


def make(sample: Column, modality: Column, real_id: Column) -> Column:
    parts = [F.concat(F.lit("s"), sample.cast("string")), F.concat(F.lit("m"), _part(modality, "modality")), F.concat(F.lit("i"), _part(real_id, "id"))]
    return F.concat_ws(SEPARATOR, *parts)


def make_partial(sample: Column | None = None, modality: Column | None = None, real_id: Column | None = None) -> Column:
    """The parts that aren't null, in their order."""
    parts = []
    if sample is not None:
        parts.append(F.concat(F.lit("s"), sample.cast("string")))
    if modality is not None:
        parts.append(F.concat(F.lit("m"), _part(modality, "modality")))
    if real_id is not None:
        parts.append(F.concat(F.lit("i"), _part(real_id, "id")))
    return F.concat_ws(SEPARATOR, *parts)


def parse(vid: Column) -> Column:
    """struct(sample, modality, real_id); a key of another form is an error."""
    parts = F.split(vid, SEPARATOR)
    good = vid.rlike("^s-?[0-9]+__m[^_]*(_[^_]+)*__i.+$") & (F.size(parts) == 3)
    fields = F.struct(
        F.substring(F.get(parts, F.lit(0)), 2, 1 << 30).cast("int").alias("sample"),
        F.substring(F.get(parts, F.lit(1)), 2, 1 << 30).alias("modality"),
        F.substring(F.get(parts, F.lit(2)), 2, 1 << 30).alias("real_id"),
    )
    return F.when(good, fields).otherwise(F.raise_error(F.concat(F.lit("no entity key: "), F.coalesce(vid, F.lit("null")))))


def joined(*parts: Column) -> Column:
    """A file's or model's name from its parts, leaving out those that are null or empty."""
    kept = F.filter(F.array(*[p.cast("string") for p in parts]), lambda p: p.isNotNull() & (p != ""))
    return F.array_join(kept, "_")


def slice_key(vid: Column, dim: Column, index: Column, last: Column) -> Column:
    return F.concat(vid, F.lit(SEPARATOR), dim, index.cast("string"), F.when(last, END).otherwise(""))


def parse_slice(svid: Column) -> Column:
    """struct(vid, dim, slice_idx, is_end)."""
    form = "^(.*)__([xyz])([0-9]+)(<end>)?$"
    get = lambda k: F.regexp_extract(svid, form, k)
    return F.struct(get(1).alias("vid"), get(2).alias("dim"), get(3).cast("int").alias("slice_idx"), (get(4) != "").alias("is_end"))
