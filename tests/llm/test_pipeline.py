"""The pipeline, stage by stage, and the query lists."""

from __future__ import annotations

import hashlib

import pytest

import corpus_pipeline
from tests.llm.conftest import CLASHING
from voxlake.llm import exact_dedup, queries, quality_cnn


def test_stages_in_order(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    frames, now = [], docs
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.materialise(stage(spark, now, sf), name.replace(" ", "-"))
        frames.append(now)
    good, exact, near, mixed, tokens = frames
    assert all(f.columns == docs.columns for f in frames[:4])
    accepted = {r["doc_id"] for r in quality_cnn.judged(docs, labels).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in good.collect()} == accepted
    assert {r["doc_id"] for r in exact.collect()} == {r["doc_id"] for r in exact_dedup.decisions(good).where("kept").collect()}
    assert {r["doc_id"] for r in near.collect()} <= {r["doc_id"] for r in exact.collect()}
    assert {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in near.collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = tokens.collect()
    assert len(rows) == mixed.count() > 0
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in rows)


def test_stages_of_odd_rows(spark, odd, empty, tmp_path):
    """Nulls in any column, empty, blank and very long texts, repeated rows, and columns with the operators' own names."""
    spark.createDataFrame([(1, 1), (3, 0), (5, 1), (8, 1), (4, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = odd.count()
    for name, stage in corpus_pipeline.STAGES[:4]:
        found = stage(spark, odd, str(tmp_path))
        assert found.columns == odd.columns and found.count() <= (3 * rows if name == "source mixing" else rows)
        assert all(r[c] == "own" for r in found.collect() for c in CLASHING)
        nothing = stage(spark, empty, str(tmp_path))
        assert nothing.columns == empty.columns and nothing.collect() == []
    copies = corpus_pipeline.drop_copies(spark, odd, str(tmp_path)).collect()
    normal = {"".join(c for c in r["text"] or "" if c not in " \t\n\x0b\f\r") for r in odd.collect()}
    assert len(copies) == len(normal)
    tokens = corpus_pipeline.tokenise(spark, odd, str(tmp_path))
    assert tokens.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and tokens.count() == rows
    assert corpus_pipeline.tokenise(spark, empty, str(tmp_path)).collect() == []


@pytest.mark.parametrize("number", range(1, 11))
def test_every_operator_has_a_query(number):
    assert len([n for n in queries.QUERIES if n.startswith(f"op{number}_")]) == 1
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    found = queries.QUERIES[name](spark, sf)
    relation = con.sql(queries.ORACLE_SQL[name])
    assert found.columns == relation.columns
    assert sorted(map(tuple, found.collect()), key=str) == sorted(relation.fetchall(), key=str)
