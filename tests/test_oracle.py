"""Every query that has SQL gives that SQL's rows in DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from tests.conftest import SF
from voxlake.catalog import experiments, extensions, matching, registration, volumes

CASES = [(name, query, catalog.sql[name]) for catalog in (volumes.C, matching.C, registration.C, experiments.C, extensions.C) for name, query in catalog.queries.items() if name in catalog.sql]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(plain, value)) + "]"
    return repr(value + 0.0) if isinstance(value, float) else repr(value)


@pytest.mark.parametrize(("name", "query", "sql"), CASES, ids=[c[0] for c in CASES])
def test_same_rows(spark, duck, sf, name, query, sql):
    found = query(spark, sf)
    columns = sorted(found.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    relation = duck.sql(sql if sql.lstrip().startswith("SELECT") else f"WITH {sql}")
    at = [relation.columns.index(c) for c in columns]
    assert sorted(relation.columns) == columns
    assert rows == sorted(tuple(plain(r[k]) for k in at) for r in relation.fetchall())
