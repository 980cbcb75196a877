"""Spelling variants: words of a corpus that differ by one edit, grouped to their most frequent forms.

Words are counted in one pass over the texts. A pair within one edit (one code point inserted, deleted or replaced) has lengths m, or m - 1
and m; m is its class. Wherever the edit is, two thirds of the word stay as they are: a prefix, a suffix, or both ends. Words
are dealt by class and by these three, so both of a pair meet in a group; groups above `GROUP` words are cut into blocks, and every
two blocks meet in a cell of their own.

A cell has a positional q-gram inverted index, q = (m - 1) // 2. One edit leaves at least T = m - 2q + 1 q-grams in both words, in
place or moved by one. Each word's posting lists are cut to the lengths and places that one edit allows, and merged by a heap;
words that it meets at least T times are candidates, and those are verified. T is 2 or 3, so most words of a group never become one.

A word's form is its near word of largest count, if that is at least `RATIO` times its own; so forms only rise, and pointers doubled in
rounds of joins reach the last.

Defined results: null and empty texts have no words; a null id is the empty string in the hash that deletes code points; repeated
rows count again; ties go to the smaller word in code-point order; words of any length are indexed by hashes of their q-grams, which
may only add candidates; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.llm.scratch import discard, give_back, materialise
from voxlake.llm.terms import ascii_lowered, matches

#: Runs of letters in texts whose A-Z are lower-cased.
PATTERN = "[a-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: One of so many (document, run) pairs loses a code point.
MARKED = 97
#: Words of a group that meet in one cell, and words (about) of the cells that one task gets.
GROUP, PART_WORDS = 1024, 1 << 16
MAX_ROUNDS = 64

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def marked(doc_id: Column, run: Column) -> Column:
    """run, without the code point that the hash of id and run points to, if the hash is one that marks."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.char_length(run)).cast("int")
    return F.when(h % MARKED == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n of the words of docs(doc_id, text)."""
    runs = docs.select("doc_id", F.explode(matches(ascii_lowered(F.coalesce("text", F.lit(""))), PATTERN)).alias("run"))
    words = runs.where(F.char_length("run") >= least_length).select(marked(F.col("doc_id"), F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def gram_size(m: int) -> int:
    return (m - 1) // 2


def _groups(words: DataFrame) -> DataFrame:
    """key, m, word, n: every word in its two classes, by what an edit after, before and within its middle leaves."""
    length = F.char_length("word")
    rows = words.select("word", "n", length.alias("length"), F.explode(F.array(length, length + 1)).alias("m"))
    rows = rows.withColumn("whole", F.floor(F.col("m") * 2 / 3).cast("int")).withColumn("end", F.col("m") - F.col("whole"))
    head = lambda n: F.substring("word", F.lit(1), F.col(n))
    tail = lambda n: F.substring("word", F.col("length") - F.col(n) + 1, F.col(n))
    kinds = (F.xxhash64(F.lit(0), "m", head("whole")), F.xxhash64(F.lit(1), "m", tail("whole")), F.xxhash64(F.lit(2), "m", head("end"), tail("end")))
    return rows.select("word", "n", "m", F.explode(F.array(*kinds)).alias("key"))


def _cells(words: DataFrame) -> DataFrame:
    """part, cell, m, word, n of the groups of two words and more."""
    rows = materialise(_groups(words), "spelling-groups")
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    counts = counts.select("key", F.ceil(F.col("size") / GROUP).cast("int").alias("blocks"))
    found = rows.join(counts, "key")
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    found = found.select("key", "m", "word", "n", own.alias("own"), other.alias("other"))
    found = found.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "m", "word", "n")
    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // PART_WORDS)
    return found.select(F.pmod(F.xxhash64("cell"), F.lit(parts)).alias("part"), "cell", "m", "word", "n")


def _grams(words: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every word's grams of its own size: the word's number, a hash of the gram, and its place."""
    lengths = np.array([len(w) for w in words])
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        power = lambda base: np.cumprod(np.append(np.uint64(1), np.full(max(len(points) - 1, 0), base)))[: len(points)]
        sums = np.append(np.uint64(0), np.cumsum(points * power(_BASE)))
        counts = lengths - sizes + 1
        owner = np.repeat(np.arange(len(words)), counts)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = (np.cumsum(lengths) - lengths)[owner] + place
        codes = (sums[start + sizes[owner]] - sums[start]) * power(_INVERSE)[start]
    return owner, codes, place


def one_edit(a: str, b: str) -> bool:
    """Whether b, at least as long as a, is a with one code point replaced or inserted."""
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def _pairs(words: list[str], m: int) -> Iterator[tuple[int, int]]:
    """Pairs of numbers of distinct words, of lengths m - 1 and m, that one edit parts and that class m finds: at least one has length m.
    Posting lists hold a word's number and are ascending; shorter words come first."""
    order = sorted(range(len(words)), key=lambda k: (len(words[k]), words[k]))
    words = [words[k] for k in order]
    q = gram_size(m)
    least = m - 2 * q + 1
    owner, codes, place = _grams(words, np.full(len(words), q))
    lists: dict[tuple[int, int], list[int]] = {}
    of: list[list[tuple[int, int]]] = [[] for _ in words]
    for w, gram in zip(owner.tolist(), zip(codes.tolist(), place.tolist(), strict=True), strict=True):
        lists.setdefault(gram, []).append(w)
        of[w].append(gram)
    short = next((k for k, w in enumerate(words) if len(w) == m), len(words))
    for b in range(short, len(words)):
        # words before b: of its own length in the same place, shorter ones in the same place or one before
        postings = []
        for code, at in of[b]:
            here, before = lists[code, at], lists.get((code, at - 1), ())
            if here[0] < b:
                postings.append(here)
            if before and before[0] < short:
                postings.append([x for x in before if x < short])
        if len(postings) < least:
            continue
        last, seen = -1, 0
        for a in heapq.merge(*postings):
            if a >= b:
                break
            last, seen = (a, seen + 1) if a == last else (a, 1)
            if seen == least and one_edit(words[a], words[b]):
                yield order[a], order[b]


def _near(part: pa.Table) -> pa.Table:
    """The near words of each cell of a part: a, n_a, b, n_b with a < b."""
    give_back()
    cell = part.column("cell").to_numpy()
    order = np.argsort(cell, kind="stable")
    edges = np.flatnonzero(cell[order][1:] != cell[order][:-1]) + 1
    words, ms, ns = part.column("word").to_pylist(), part.column("m").to_numpy(), part.column("n").to_numpy()
    rows = set()
    for group in np.split(order, edges):
        # keys of several classes may meet by chance; words of one cell may come twice
        for m in np.unique(ms[group]):
            own = {words[k]: int(ns[k]) for k in group.tolist() if ms[k] == m}
            names = [*own]
            if len(names) > 1:
                rows.update((min(x, y), max(x, y)) for i, j in _pairs(names, int(m)) for x, y in [((names[i], own[names[i]]), (names[j], own[names[j]]))])
    a, b = [x for x, _ in rows], [y for _, y in rows]
    return pa.table({"a": pa.array([w for w, _ in a], pa.string()), "n_a": pa.array([n for _, n in a], pa.int64()), "b": pa.array([w for w, _ in b], pa.string()), "n_b": pa.array([n for _, n in b], pa.int64())})


def near_words(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b of every two words(word, n) that one edit parts, once."""
    return _cells(words).groupBy("part").applyInArrow(_near, "a string, n_a long, b string, n_b long").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """word and root (its last form) of forms(word, form), by doubling pointers."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(MAX_ROUNDS):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        if now.join(ahead, "root", "left_semi").isEmpty():
            return now
        further = materialise(now.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root")), "spelling-roots")
        discard(now)
        now = further
    raise RuntimeError("forms don't end")


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of docs(doc_id, text)."""
    words = materialise(word_counts(docs, least_length, least_count), "spelling-words")
    pairs = materialise(near_words(words), "spelling-pairs")
    ends = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    ends = pairs.select(F.explode(ends).alias("e")).select("e.*")
    best = ends.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    rows = words.join(best, "word", "left")
    is_form = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    rows = materialise(rows, "spelling-forms")
    roots = _roots(rows.where("form IS NOT NULL"))
    discard(words, pairs)
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: crc32 by its table of 256 remainders; near words by equal texts after deletions.
ORACLE_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT n, n::BIGINT AS c, 0 AS k FROM range(256) r(n) UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY n) AS t FROM steps WHERE k = 8
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents
), counts AS (
  SELECT doc_id, run, count(*) AS n, hex(encode(concat(doc_id, ':', run))) AS x FROM runs WHERE length(run) >= 5 GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(x) // 2), lambda i: concat('0x', x[2 * i + 1 : 2 * i + 2])::BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) AS h
  FROM counts, crc
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN concat(substring(run, 1, h % length(run)), substring(run, h % length(run) + 2)) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cut AS (
  SELECT word, k, concat(substring(word, 1, k), substring(word, k + 2)) AS rest FROM (SELECT word, unnest(range(0, length(word))) AS k FROM words)
), near AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON b.rest = a.rest AND b.k = a.k AND b.word <> a.word
  UNION SELECT c.word, w.word FROM cut c JOIN words w ON w.word = c.rest UNION SELECT w.word, c.word FROM cut c JOIN words w ON w.word = c.rest
), best AS (
  SELECT near.word, count(*) OVER (PARTITION BY near.word) AS n_near, other, w.n AS other_n, row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, encode(other)) AS place FROM near JOIN words w ON w.word = other
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 2 * w.n THEN b.other END AS form, CASE WHEN b.other_n >= 2 * w.n THEN b.other_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND b.place = 1
), follow AS (
  SELECT word, word AS root FROM forms UNION ALL SELECT f.word, g.form FROM follow f JOIN forms g ON g.word = f.root WHERE g.form IS NOT NULL
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN follow r ON r.word = f.word JOIN forms e ON e.word = r.root WHERE e.form IS NULL
"""
