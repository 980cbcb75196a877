"""The n-gram Jaccard join against brute force over all pairs, at every boundary and with small buckets and cells."""

from __future__ import annotations

import random
import re
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import CLASHING, rows_of
from voxlake.llm import ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def joined(rows, similarity=Fraction(90, 100)):
    """ngram_join.join by brute force over (doc_id, text)."""
    sets = []
    for _, text in rows:
        words = WORD.findall((text or "").translate(LOWER))
        sets.append({*zip(words, words[1:], words[2:], strict=False)} if len(words) > 2 else {tuple(words)} if words else set())
    group = [*range(len(rows))]

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) >= similarity * len(a | b):
                group[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if sets[i] and ids else doc_id))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def copies():
    """Groups of near copies around the threshold, chains in which each is like the next only, texts of 0 to 40 words, repeats."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(400)}"
    texts = [None, "", "  ", "a", "A", "a b", "B a", "a  b", "a b c", "A b\tc"]
    for size in (11, 12, 14, 25, 60, 150):
        base = [word() for _ in range(size)]
        for _ in range(14):
            own = base[:]
            for _ in range(rng.randrange(4)):
                own[rng.randrange(size)] = word()
            texts.append(" ".join(own[rng.randrange(3) :]))
    chain = [f"c{k}" for k in range(130)]
    texts += [" ".join(chain[k : k + 60]) for k in range(0, 70, 2)]
    texts += [" ".join(word() for _ in range(rng.randrange(40))) for _ in range(60)]
    texts += texts[::9]
    rng.shuffle(texts)
    return [*enumerate(texts), (3, "w1 w2 w3"), (None, chain[0]), (None, "a b c")]


@pytest.mark.parametrize("light", [None, 0, 12, 30, 128])
@pytest.mark.parametrize("small", [False, True])
def test_join_of_copies(spark, copies, monkeypatch, light, small):
    if small:
        monkeypatch.setattr(ngram_join, "SMALL", 2)
        monkeypatch.setattr(ngram_join, "CELL", 3)
        monkeypatch.setattr(ngram_join, "CHUNK", 7)
        monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    docs = spark.createDataFrame(copies, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.join(docs, light=light).collect()), key=str) == joined(copies)


@pytest.mark.parametrize("similarity", [Fraction(1, 2), Fraction(4, 5), Fraction(1)])
def test_join_at_other_thresholds(spark, copies, similarity):
    docs = spark.createDataFrame(copies, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.join(docs, similarity, 20).collect()), key=str) == joined(copies, similarity)


def test_join_of_odd_rows(odd, odd_rows):
    clashing = odd.withColumns({c: F.lit("own") for c in (*CLASHING, "m1", "m2", "n", "tokens", "id", "key", "group", "least")})
    assert sorted(map(tuple, ngram_join.join(clashing).collect()), key=str) == joined([r[:2] for r in odd_rows])


def test_join_of_nothing(empty):
    assert ngram_join.join(empty).collect() == []


def test_join_sql(spark, sf, docs):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert rows_of(ngram_join.join(docs)) == sorted(con.sql(ngram_join.ORACLE_SQL).fetchall())


def test_boundary_is_the_cheapest(spark):
    """Short sets whose shingles are in long lists are light, others heavy."""
    schema = "n int, tokens array<long>, scan double"
    assert ngram_join.boundary(spark.createDataFrame([(k, [1, 2, 3], 0.0) for k in range(9, 40)], schema)) < 9
    assert ngram_join.boundary(spark.createDataFrame([(k, [1, 2, 3], 1000.0 * (k < 20)) for k in range(9, 40)], schema)) in range(18, 24)
