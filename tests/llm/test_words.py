"""Operators on words: the source audit and spelling variants against plain Python and SQL, odd rows and clashing names."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import CLASHING, rows_of
from voxlake.llm import source_audit, spelling

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audited(rows, min_docs, top):
    """source_audit.audit in plain Python over (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    held, counts, groups = Counter(), Counter(), defaultdict(set)
    for text, lang, source in rows:
        terms = TERM.findall(text.translate(LOWER))
        groups[lang].add(source)
        held.update((lang, t) for t in set(terms))
        counts.update((lang, source, t) for t in terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for (of, t), n in held.items() if of == lang and n >= min_docs]

        def shares(own, kept=kept):
            total = sum(own[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (own[t] + 2) // (total + 2 * len(kept)) for t in kept}

        own = {s: Counter({t: counts[lang, s, t] for t in kept}) for s in sources}
        p, q = {s: shares(own[s]) for s in sources}, shares(sum(own.values(), Counter()))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ordered, 1)]
    return sorted(out)


@pytest.mark.parametrize(("min_docs", "top"), [(1, 3), (2, 10), (10, 10), (1000, 10)])
def test_audit_of_documents(docs, min_docs, top):
    rows = [(r["text"], r["lang"], r["source"]) for r in docs.collect()]
    assert sorted(map(tuple, source_audit.audit(docs, min_docs, top).collect())) == audited(rows, min_docs, top)


@pytest.mark.parametrize("min_docs", [1, 2, 3])
def test_audit_of_odd_rows(odd, odd_rows, min_docs):
    clashing = odd.withColumns({c: F.lit("own") for c in ("term", "n", "p", "terms", "item", "value", "rank", "part", "total", "_salt")})
    assert sorted(map(tuple, source_audit.audit(clashing, min_docs).collect())) == audited([r[1:4] for r in odd_rows], min_docs, 10)


def test_audit_of_nothing(empty, spark):
    assert source_audit.audit(empty).collect() == []
    one = spark.createDataFrame([("a b", None, None), (None, None, None), ("a", None, "x")], "text string, lang string, source string")
    assert rows_of(source_audit.audit(one, 5)) == [("", "", "pair", "x", 0, 1), ("", "x", "pair", "", 0, 1)]


def test_audit_sql(spark, sf, docs):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(tuple, source_audit.audit(docs).collect())) == sorted(con.sql(source_audit.ORACLE_SQL).fetchall())


RUN = re.compile("[A-Za-z\u00c0-\u00ff]+")


def spelled(rows, least_length=5, least_count=3, ratio=2):
    """spelling.variants over (doc_id, text), with all deletions of all words as keys."""
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall((text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            word = run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[word] += len(word) >= least_length
    n = {w: c for w, c in counts.items() if c >= least_count}
    replaced, near = defaultdict(set), defaultdict(set)
    for w in n:
        for k in range(len(w)):
            replaced[k, w[:k], w[k + 1 :]].add(w)
            shorter = w[:k] + w[k + 1 :]
            if shorter in n:
                near[w].add(shorter)
                near[shorter].add(w)
    for same in replaced.values():
        for w in same:
            near[w] |= same - {w}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: x for w, x in best.items() if n[x] >= ratio * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n), key=str)


@pytest.fixture(scope="module")
def misspelt():
    """Words of few letters, many of them one edit apart, repeated letters, long words, marked runs and null ids."""
    rng = random.Random(3)
    words = ["".join(rng.choice("ab\u00e9") for _ in range(rng.randrange(4, 10))) for _ in range(300)]
    words += ["aaaaa", "aaaaaa", "aaaaaaa", "Aaaaaaaa", "x" * 400, "x" * 401, "x" * 402, "x" * 200 + "y" + "x" * 200, "stra\u00dfe", "strasse", "STRASSE", "caf\u00c9s", "caf\u00e9s", "\u00d7\u00f7\u00f7\u00d7\u00d7", "\u00d7\u00f7\u00f7\u00d7"]
    text = lambda: " ".join(words[min(int(rng.expovariate(0.02)), len(words) - 1) if rng.random() < 0.7 else rng.randrange(len(words))] for _ in range(60))
    rows = [(k, text()) for k in range(80)] + [(None, text()), (None, None), (7, ""), (7, "1 2 3 ?!"), (8, "\u0100bcdef naïve\u0301 \u65e5\u672c")]
    return rows + rows[:4]


@pytest.mark.parametrize("group", [1024, 3])
def test_variants_of_misspelt_words(spark, misspelt, monkeypatch, group):
    monkeypatch.setattr(spelling, "GROUP", group)
    docs = spark.createDataFrame(misspelt, "doc_id long, text string")
    found = sorted(map(tuple, spelling.variants(docs).collect()), key=str)
    assert found == spelled(misspelt)
    assert any(r[1] is not None and r[2] != r[1] for r in found)


@pytest.mark.parametrize(("length", "count", "ratio"), [(3, 1, 1.5), (5, 3, 2), (8, 2, 3), (5, 10**6, 2)])
def test_variants_of_documents(docs, length, count, ratio):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, spelling.variants(docs, length, count, ratio).collect()), key=str) == spelled(rows, length, count, ratio)


def test_variants_of_odd_rows(odd, odd_rows, empty):
    clashing = odd.withColumns({c: F.lit("own") for c in (*CLASHING, "word", "run", "n", "m", "key", "length", "root", "form")})
    assert sorted(map(tuple, spelling.variants(clashing, 5, 1).collect()), key=str) == spelled([r[:2] for r in odd_rows], 5, 1)
    assert spelling.variants(empty).collect() == []


def test_variants_sql(spark, sf, docs):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(tuple, spelling.variants(docs).collect()), key=str) == sorted(con.sql(spelling.ORACLE_SQL).fetchall(), key=str)


def test_one_edit_by_all_pairs():
    words = [*{"".join(random.Random(k).choice("ab") for _ in range(3 + k % 5)) for k in range(200)}]
    for a in words:
        for b in words:
            if len(a) <= len(b):
                edits = {b[:k] + c + b[k + 1 :] for k in range(len(b)) for c in ("", "a", "b")} - {b}
                assert spelling.one_edit(a, b) == (a in edits), (a, b)
