"""Queries over volumes whose last plane isn't whole give their SQL's rows, too."""

from __future__ import annotations

import duckdb
import pytest

from tests.conftest import SF
from tests.test_oracle import CASES, plain

NAMES = (
    "E11_volume_convolution", "E1_E2_streamed_projection", "E3_E6_two_taps_of_a_plan", "S14_zoomed_by_splines",
    "J9_warp_trilinear", "J9_warp_features", "J12_field_composition", "J15_cost_volume",
    "J12_affine_composition", "P33_identity_grid", "P34_affine_to_dense", "J13_line_resample",
    "W8_box_mean", "W9_gaussian", "W12_binary_dilation", "W10_W11_self_similarity", "W13_fill_holes_26", "W14_generated_mask", "R7_smoothing_snapshots",
)
#: Voxels of the last of five planes of four entities: h = 3 has w < 3 only, and h = 4 none.
VECTORS = 4 * (4 * 25 + 18)


@pytest.fixture(scope="module")
def ragged(tmp_path_factory):
    folder = tmp_path_factory.mktemp("ragged")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '{SF}/embeddings.parquet' WHERE vec_id < {VECTORS}) TO '{folder}/embeddings.parquet'")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_of_ragged_volumes(spark, ragged, name):
    folder, con = ragged
    query, sql = next((q, s) for n, q, s in CASES if n == name)
    found = query(spark, folder)
    columns = sorted(found.columns)
    relation = con.sql(sql if sql.lstrip().startswith("SELECT") else f"WITH {sql}")
    at = [relation.columns.index(c) for c in columns]
    want = sorted(tuple(plain(r[k]) for k in at) for r in relation.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in found.collect()) == want
    assert want
