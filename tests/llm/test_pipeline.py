from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import decontam, mixing, pii, quality_rules, simhash

SF = "/root/testdata/sf0.001"


def test_stages_equal_the_operators(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    out = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out[name] = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out[name].columns == columns
        out[name].write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
        if name == "quality rules":
            assert ids(docs) == ids(quality_rules.apply_rules(before).where("kept"))
        if name == "near-dedup":
            near = simhash.near_duplicates(before)
            assert ids(docs) == ids(near.where("doc_id = component_id").distinct())
        if name == "decontamination":
            assert ids(docs) == ids(decontam.scan(before, spark.read.parquet(f"{SF}/benchmark.parquet")).where("NOT contaminated"))
        if name == "pii":
            want = {r.doc_id: pii.redact_text(r.text) for r in before.collect()}
            assert {r.doc_id: r.text for r in docs.collect()} == want
            assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
        if name == "mix":
            assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, mixing.mix(before).collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))


def test_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, docs, SF).count()
            assert rows <= docs.count()
