import pytest
from pyspark.sql import functions as F

from millrace.sources import tables

HEAD = "timestamp,zone,station_id,sensor_id,sensor_type,value,unit\n"


def write(tmp_path, text):
    p = tmp_path / "in.csv"
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_scan_keeps_text_and_reports_violations(spark, tmp_path):
    rows = ["2024-01-01T00:00:00,z,s,a,t,3.30,C", "2024-01-01T00:00:30,z,s,a,t,NaN,C", "2024-01-01T00:00:45,z,s,a,t,1,C", "2024-01-01T00:02:00,z,s,a,t,2,F", "2024-01-01T00:02:00,z,s,a,t,2,C", "2024-01-01T00:00:00+09:00,z,s,b,t,1,C", "2024-01-01T00:00:00,z,s,c,t,,C"]
    obs = tables.observations(tables.read_csv(spark, write(tmp_path, HEAD + "\n".join(rows)), tables.OBSERVATION))
    assert obs.first().value == "3.30"
    dim = spark.createDataFrame([("a", "C"), ("c", "C")], "sensor_id string, unit string")
    got = sorted((r.code, r.sensor_id) for r in tables.violations(obs, dim, 30).collect())
    assert got == [("bad_timestamp", "b"), ("bad_value", "a"), ("bad_value", "c"), ("duplicate", "a"), ("duplicate", "a"), ("off_grid", "a"), ("unit_mismatch", "a"), ("unknown_sensor", "b")]
    kinds = sorted((r.kind, r.missing_slots) for r in tables.problems(obs.where("sensor_id = 'a'"), 30).collect())
    assert ("missing_value", None) in [(k, m) for k, m in kinds] and any(k == "gap" for k, _ in kinds)


def test_wrong_header_and_extra_cells_fail(spark, tmp_path):
    for text in ("zone,timestamp,station_id,sensor_id,sensor_type,value,unit\n1,2,3,4,5,6,7\n", HEAD + "1,2,3,4,5,6,7,8\n"):
        with pytest.raises(Exception):  # noqa: B017, PT011
            tables.read_csv(spark, write(tmp_path, text), tables.OBSERVATION).collect()


def test_outputs_are_new_and_sealed(spark, tmp_path):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    out = str(tmp_path / "out")
    tables.write_new(df, out)
    with pytest.raises(Exception):  # noqa: B017, PT011
        tables.write_new(df, out)
    with pytest.raises(ValueError):
        tables.write_new(df, "/raw/data/x", "/raw/data")
    seal = tables.manifest(df, "t")
    assert tables.seal_breaks(spark.read.parquet(out), seal, "t").count() == 0
    assert tables.seal_breaks(df.withColumn("x", F.when(F.col("id") == 5, 0).otherwise(F.col("x"))), seal, "t").count() > 0


def test_columns_by_name(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, Anomaly_Label int, b int")
    assert tables.forbidden_columns(df, ["anomaly-label"]) == ["Anomaly_Label"]
    assert tables.label_columns(df, df.select("a")) == ["Anomaly_Label", "b"]


def test_jsonl_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, "ä"), (2, None)], "a long, b string")
    tables.write_jsonl(df, str(tmp_path / "j"))
    assert sorted(map(tuple, tables.read_jsonl(spark, str(tmp_path / "j"), "a long, b string").collect())) == [(1, "ä"), (2, None)]
