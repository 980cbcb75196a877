"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Each source's target divided by its size is the number of copies, a fraction, that every one of its documents should have.
The whole part is certain. The fractional parts are rounded in pairs: of two documents one gains and the other loses
probability, weighed by size so that the source's expected words stay as they are, in a random direction that keeps each
document's chance, until one of the two is 0 or 1. A block of about `BLOCK` documents leaves at most one fraction, the
residuals of blocks form the blocks of the next level, and the tree ends with one fraction for each source, which is drawn.
A source's taken words thus miss its target by less than its largest document. Rows that repeat an id and a text are one
unit of the tree: their fractions add up to a whole number of copies and one fraction, so any number of them is one row
there. All draws are hashes: reruns agree.

Defined results: a null text has size 0, and a document of size 0 is taken 0 times; null is a source, the last; a source
of size 0 has target 0; repeated rows are rows of their own; an empty table gives an empty result; other columns are
ignored by `mix` and returned untouched by `resample`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.llm.scratch import materialise

WEIGHTS = (1.0, 2.0, 3.0)
CAP = 3.0
#: Documents in one block of the reduction tree, on average.
BLOCK = 64
#: The table of sources is broadcast up to this many rows, and joined by shuffle beyond.
BROADCAST_ROWS = 100_000
_EPS = 1e-9
_WORDS = "[^\\x20\\x09-\\x0D]+"

_UNIT = "struct<doc_id:bigint,mark:bigint,size:bigint,sure:bigint,rows:bigint,p:double>"
_DONE = "struct<doc_id:bigint,mark:bigint,size:bigint,sure:bigint,rows:bigint,extra:int>"
_STATE = f"struct<open:boolean,rest:{_UNIT},done:array<{_DONE}>>"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, cap: float = CAP) -> DataFrame:
    """sizes(source, source_size) with sid and target: weights repeat over sources in code point order, null last, and a
    target stops at cap times its source's size, the excess going to the others by weight. With sources in the order of
    cap / weight, those before the first that its fair share doesn't exceed are capped: two running sums over the table
    of sources, the only table here that one task sees whole."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("sid", F.row_number().over(order))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") - 1) % len(weights) + 1)
    rows = rows.withColumns({"_weight": weight, "_cap": F.col("source_size") * F.lit(cap)})
    rows = rows.withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    by = Window.orderBy("_ratio", "sid")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(0, Window.unboundedFollowing)
    everything = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(share)
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(after)
    rows = rows.withColumn("_level", level)
    rows = rows.withColumn("_free", F.min(F.when(F.col("_level") < F.col("_ratio"), F.col("_level"))).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.first("_free", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    target = F.when(first.isNull(), F.col("_cap")).otherwise(first * F.col("_weight"))
    return rows.select("source", "source_size", "sid", F.least(target, F.col("_cap")).alias("target"))


def _uniform(*keys: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") + 0.5) / F.lit(2.0**53)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _decided(unit: Column, extra: Column) -> Column:
    return F.struct(unit["doc_id"].alias("doc_id"), unit["mark"].alias("mark"), unit["size"].alias("size"), unit["sure"].alias("sure"), unit["rows"].alias("rows"), extra.cast("int").alias("extra"))


def _pair(seed: int, level: int):
    """The merge of a fold over a block: the open fraction meets the next one."""

    def merge(state: Column, unit: Column) -> Column:
        rest = state["rest"]
        ratio = unit["size"] / rest["size"]
        rise = F.least(1 - rest["p"], unit["p"] * ratio)
        fall = F.least(rest["p"], (1 - unit["p"]) * ratio)
        draw = _uniform(F.lit(seed), F.lit(level), rest["doc_id"], rest["mark"], unit["doc_id"], unit["mark"])

        def moved(step: Column) -> Column:
            return F.struct((rest["p"] + step).alias("a"), (unit["p"] - step / ratio).alias("b"))

        def settle(p: Column) -> Column:
            done_a = (p["a"] <= _EPS) | (p["a"] >= 1 - _EPS)
            done_b = (p["b"] <= _EPS) | (p["b"] >= 1 - _EPS)
            out = F.concat(
                state["done"],
                F.filter(
                    F.array(F.when(done_a, _decided(rest, p["a"] > 0.5)), F.when(done_b, _decided(unit, p["b"] > 0.5))),
                    lambda x: x.isNotNull(),
                ),
            )
            keep = F.when(done_a, unit.withField("p", p["b"])).otherwise(rest.withField("p", p["a"]))
            return F.struct((~(done_a & done_b)).alias("open"), keep.alias("rest"), out.alias("done")).cast(_STATE)

        met = _let(_let(F.when(draw * (rise + fall) < fall, rise).otherwise(-fall), moved), settle)
        return F.when(state["open"], met).otherwise(F.struct(F.lit(True).alias("open"), unit.alias("rest"), state["done"].alias("done")).cast(_STATE))

    return merge


def _round(units: DataFrame, largest: int, block: int, seed: int) -> DataFrame:
    """units(sid, n, unit): n is a bound on the units of a source, largest the largest n. Returns sid and decided units."""
    decided, level = [], 0
    zero = F.from_json(F.lit('{"open":false,"done":[]}'), _STATE)
    while True:
        level += 1
        blocks = F.greatest(F.ceil(F.col("n") / block), F.lit(1))
        place = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "unit.doc_id", "unit.mark"), blocks)
        dealt = units.withColumn("_blocks", blocks).withColumn("_block", place)
        mixed = F.sort_array(F.collect_list(F.struct(F.xxhash64(F.lit(level), "unit.doc_id", "unit.mark").alias("h"), "unit")))
        folded = dealt.groupBy("sid", "_blocks", "_block").agg(F.transform(mixed, lambda x: x["unit"]).alias("_units"))
        folded = folded.select("sid", "_blocks", F.aggregate("_units", zero, _pair(seed, level)).alias("state"))
        folded = materialise(folded, "mix-level")
        decided.append(folded.select("sid", F.explode("state.done").alias("unit")))
        units = folded.where("state.open").select("sid", F.col("_blocks").alias("n"), F.col("state.rest").alias("unit"))
        largest = max(1, -(-largest // block))
        if largest == 1:
            last = F.col("unit.p") > _uniform(F.lit(seed), F.lit(0), F.col("unit.doc_id"), F.col("unit.mark"))
            decided.append(units.select("sid", _decided(F.col("unit"), last).cast(_DONE).alias("unit")))
            break
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out.select("sid", "unit.*")


def copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, cap: float = CAP, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs(doc_id, source, text): doc_id, mark (a hash of the text), source, size, source_size,
    target and copies."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), "source", words(F.col("text")).alias("size"))
    rows = materialise(rows, "mix-sizes")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    table = materialise(targets(sums.drop("n"), weights, share, cap).join(sums.select(F.col("source").alias("_s"), "n"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "mix-sources")
    sources, largest = table.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    small = F.broadcast if sources <= BROADCAST_ROWS else lambda df: df
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    keyed = rows.join(small(table.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s")))
    keyed = keyed.select("sid", "n", "doc_id", "mark", "size", rate.alias("rate"))
    whole = F.floor(F.col("rate") + _EPS)
    keyed = keyed.withColumns({"whole": whole.cast("int"), "p": F.greatest(F.col("rate") - whole, F.lit(0.0))})
    sure = (F.col("p") <= _EPS) | (F.col("size") == 0)
    none = keyed.where(sure).select("sid", "doc_id", "mark", "size", F.lit(0).alias("extra"))
    alike = keyed.where(~sure).groupBy("sid", "n", "doc_id", "mark", "size", "p").agg(F.count(F.lit(1)).alias("rows"))
    alike = alike.withColumn("sure", F.floor(F.col("rows") * F.col("p") + _EPS)).withColumn("p", F.greatest(F.col("rows") * F.col("p") - F.col("sure"), F.lit(0.0)))
    unit = F.struct("doc_id", "mark", "size", "sure", "rows", "p").cast(_UNIT)
    # written, as both sides below read them
    alike = materialise(alike.select("sid", "n", unit.alias("unit")), "mix-units")
    even = F.col("unit.p") <= _EPS
    settled = alike.where(even).select("sid", _decided(F.col("unit"), F.lit(0)).cast(_DONE).alias("unit")).select("sid", "unit.*")
    drawn = settled.unionByName(_round(alike.where(~even), largest, block, seed))
    drawn = drawn.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    drawn = drawn.select("sid", "doc_id", "mark", "size", (F.col("_nth") <= F.col("sure") + F.col("extra")).cast("int").alias("extra"))
    done = none.unionByName(drawn).join(small(table), "sid")
    count = F.when(F.col("size") == 0, 0).otherwise(F.floor(rate + _EPS).cast("int") + F.col("extra"))
    return done.select("doc_id", "mark", "source", "size", "source_size", "target", count.cast("int").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken."""
    return copies(docs, **options).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def resample(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with all its columns."""
    names = docs.columns
    rank = Window.partitionBy("_id", "_mark").orderBy(F.col("_source").asc_nulls_last())
    counts = copies(docs, **options).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.col("source").alias("_source"), "copies")
    counts = counts.withColumn("_nth", F.row_number().over(rank))
    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_mark"), F.col("source").alias("_source"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    rows = rows.withColumn("_nth", F.row_number().over(rank))
    same = [rows[c].eqNullSafe(counts[c]) for c in ("_id", "_mark", "_nth")]
    taken = rows.join(counts.where("copies > 0"), same[0] & same[1] & same[2])
    return taken.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("_row.*")
