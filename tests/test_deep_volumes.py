"""The slices kept of volumes deeper than any size in `part` are those that their SQL gives where `part` lists the depth."""

from __future__ import annotations

import duckdb
import pytest

from tests.conftest import SF
from tests.test_oracle import CASES, plain


@pytest.fixture(scope="module")
def deep(tmp_path_factory):
    folder = tmp_path_factory.mktemp("deep")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT 100 * d + v AS vec_id, embedding, label FROM (SELECT * FROM '{SF}/embeddings.parquet' LIMIT 1), range(103) r(d), range(8) s(v)) TO '{folder}/embeddings.parquet'")
    con.execute(f"COPY (SELECT * FROM '{SF}/part.parquet') TO '{folder}/part.parquet'")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    con.execute("CREATE VIEW part AS SELECT CAST(s AS INTEGER) AS p_size FROM range(1, 121) r(s)")
    return str(folder), con


@pytest.mark.parametrize("name", ["F5_subsample_slices", "W5_chosen_slices"])
def test_slices_of_deep_volumes(spark, deep, name):
    folder, con = deep
    query, sql = next((q, s) for n, q, s in CASES if n == name)
    found = query(spark, folder)
    columns = sorted(found.columns)
    relation = con.sql(sql if sql.lstrip().startswith("SELECT") else f"WITH {sql}")
    at = [relation.columns.index(c) for c in columns]
    want = sorted(tuple(plain(r[k]) for k in at) for r in relation.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in found.collect()) == want
    assert want
