"""Queries over whole tables, on a size that has rows beyond the first ids, against their SQL."""

import duckdb
import pytest

from millrace import plans

SF = "/root/testdata/sf0.01"
NAMES = [
    "run_equivalence_all", "sealed_manifest_all", "evidence_path_check_all", "overlay_loader_checks_all",
    "line_blocks_all", "fused_with_tail_all", "fixed_chunks_all",
    "scalar_text_all", "evidence_universe_all",
]


@pytest.mark.parametrize("name", NAMES)
def test_whole_table(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = plans.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({plans.oracle_sql()[name]})").fetchall()
    assert sorted(str(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(map(str, want))
    cut = con.sql(plans.oracle_sql()[name.removesuffix("_all")]).fetchall()
    assert sorted(map(str, cut)) != sorted(map(str, con.sql(plans.oracle_sql()[name]).fetchall()))
