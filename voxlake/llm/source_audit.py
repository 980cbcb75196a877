"""How far the sources of a language diverge in their words: a plain relational audit in DataFrame functions.

Terms are matches of a pattern, exploded and counted for each group (lang, source). A language keeps the terms that enough of
its documents hold. Groups meet the kept terms of their language, which makes counts of 0 rows like all others; shares are
whole numbers out of `SCALE`, smoothed, so every figure is exact. A self-join on language and term, summed up, compares each
two sources; a window ranks them, and another the terms that a source has more of than its language.

One pass reads the texts: a document's terms and then its distinct terms are exploded together, so occurrences and documents
are counted by one aggregation that starts before the shuffle. Kept terms are dealt to salts when they meet their language's
groups, so a language with most of the rows is not one task. Each two sources of a term meet once, not twice, and are added up
where they meet.

Defined results: null texts, languages and sources are ''; a group without terms is compared like any other; a language
without kept terms has values of 0; repeated rows are documents of their own; texts are read whole; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.llm.scratch import materialise
from voxlake.llm.terms import ascii_lowered, matches

#: Letters of ASCII and all characters beyond it.
PATTERN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS, TOP = 10, 10
#: Shares are parts of this; SMOOTH is added to each count.
SCALE, SMOOTH = 1_000_000_000, 2


def term_counts(docs: DataFrame, pattern: str = PATTERN) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold it) of rows (lang, source, text) without nulls."""
    rows = docs.select("lang", "source", matches(ascii_lowered(F.col("text")), pattern).alias("terms"))
    rows = rows.select("lang", "source", F.size("terms").alias("all"), F.posexplode(F.concat("terms", F.array_distinct("terms"))).alias("at", "term"))
    occurs = F.col("at") < F.col("all")
    return rows.groupBy("lang", "source", "term").agg(F.count(F.when(occurs, 1)).alias("n"), F.count(F.when(~occurs, 1)).alias("docs"))


def share(n: Column, total: Column, vocabulary: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * vocabulary)), in decimals that hold any count."""
    whole = lambda x: x.cast("decimal(20,0)")
    parts = F.lit(SCALE).cast("decimal(10,0)") * (whole(n) + F.lit(SMOOTH).cast("decimal(1,0)"))
    return F.call_function("div", parts, whole(total) + F.lit(SMOOTH).cast("decimal(1,0)") * whole(vocabulary)) + F.lit(1).cast("long")


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of shares, which are at most SCALE + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _dense(spark_parts: int, terms: DataFrame, groups: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, term, source and share p of every group and kept term of its language, and one row with the term '' and the same
    share for every group: languages without kept terms are compared by it, as equal."""
    salt = F.pmod(F.xxhash64("term"), F.lit(spark_parts)).cast("int")
    dealt = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(spark_parts - 1))))
    met = terms.withColumn("_salt", salt).join(dealt, ["lang", "_salt"]).drop("_salt")
    met = met.join(kept.select("lang", "term", "source", "n"), ["lang", "term", "source"], "left")
    shares = met.select("lang", "term", "source", share(F.coalesce("n", F.lit(0)), F.col("total"), F.col("vocabulary")).alias("p"))
    return shares.unionByName(groups.select("lang", F.lit("").alias("term"), "source", F.lit(1).cast("long").alias("p")))


def _ranked(rows: DataFrame, part: str, top: int | None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    rows = rows.withColumn("rank", F.row_number().over(order))
    rows = rows if top is None else rows.where(F.col("rank") <= top)
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank over docs(text, lang, source). Part `pair`: each other source of the language,
    by divergence over all kept terms; part `term`: the top terms of which a source has more than its language."""
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    over = Window.partitionBy("lang", "term")
    counts = term_counts(docs).withColumns({"lang_docs": F.sum("docs").over(over), "lang_n": F.sum("n").over(over)})
    kept = materialise(counts.where(F.col("lang_docs") >= min_docs).select("lang", "term", "source", "n", "lang_n"), "audit-kept")
    terms = materialise(kept.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")), "audit-terms")
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("vocabulary"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    none = {"total": 0, "vocabulary": 0, "lang_total": 0}
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(none)
    groups = materialise(groups, "audit-groups")

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dense = materialise(_dense(parts, terms.select("lang", "term"), groups, kept), "audit-shares")
    one, other = (dense.select("lang", "term", F.col("source").alias(x), F.col("p").alias(f"p_{x}")) for x in "ab")
    met = one.join(other, ["lang", "term"]).where(F.col("a") < F.col("b"))
    sums = met.groupBy("lang", "a", "b").agg(F.sum(divergence(F.col("p_a"), F.col("p_b"))).alias("value"))
    ends = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    pairs = sums.select("lang", "value", F.explode(ends).alias("end")).select("lang", "end.source", "end.item", "value")

    own = kept.join(groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("vocabulary")), share(F.col("lang_n"), F.col("lang_total"), F.col("vocabulary"))
    more = own.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    more = more.select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value"))
    return _ranked(pairs, "pair", None).unionByName(_ranked(more, "term", top))


ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), hits AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS n FROM hits GROUP BY ALL HAVING count(DISTINCT doc) >= 10
), langs AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY ALL
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM hits SEMI JOIN kept USING (lang, term) GROUP BY ALL
), totals AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts c USING (lang, source) GROUP BY ALL
), shares AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (t.total::HUGEINT + 2 * l.v) AS p,
         1 + 1000000000::HUGEINT * (k.n + 2) // (l.total::HUGEINT + 2 * l.v) AS q
  FROM totals t JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM totals a JOIN totals b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM (FROM pairs UNION ALL FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
