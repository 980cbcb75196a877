from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASHING = ["_hash", "_row", "_norm", "size", "copies", "quality_score", "component", "node", "_kept", "label", "ids", "shard", "n1"]


@pytest.fixture(scope="session")
def odd_rows() -> list[tuple]:
    """Nulls, empty and blank texts, repeated rows and ids, one word, one very long text, other alphabets."""
    long = " ".join(f"word{k % 977}" for k in range(60_000))
    return [
        (1, "one two three four five six seven", "en", "a", 7),
        (1, "one two three four five six seven", "en", "a", 7),
        (1, "another text under the same id", None, "b", None),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, " \t\n\x0b\f\r ", "en", None, 7),
        (None, "a row without an id", "en", "b", 1),
        (None, None, None, None, None),
        (5, "x", "de", "b", 1),
        (6, "onetwo three four five  six seven", "en", "a", 7),
        (7, long, "en", "a", len(long)),
        (8, "日本語 のテキスト 🙂 ñandú   ß\n\nsecond  line\n", "ja", "c", 3),
        (9, "one two three four five six seven", "en", "c", 7),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(odd_rows, SCHEMA).withColumns({c: F.lit("own") for c in CLASHING})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is not None, str(type(v)), v) if not isinstance(v, list) else (True, "list", str(v)) for v in r))
