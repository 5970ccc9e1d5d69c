"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from millrace import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(x):
    return None if isinstance(x, float) and math.isnan(x) else x


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_equals_oracle(spark, con, name):
    df = plans.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    if name not in plans.oracle_sql():
        return
    want = con.sql(plans.oracle_sql()[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert got == sorted(str(tuple(norm(r[i]) for i in at)) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "severity" in df.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_one_shuffle_by_series(spark):
    """The alarms of one rule are one exchange on the series key beyond the bucketing."""
    from millrace.operators import series

    g = series.grid(spark.read.parquet(f"{SF}/events.parquet"), 3600)
    a = series.persistent(series.with_runs(series.with_segments(g, 3600), "v > 60"), "7200")
    plan = a._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_filters_and_columns_reach_the_scan(spark):
    plan = plans.queries()["filtered_kg_query"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(c_mktsegment,BUILDING)" in plan
    plan = plans.queries()["target_partition"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string>" in plan
