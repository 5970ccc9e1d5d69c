import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from millrace.llm import quality_rules, queries


def repeat_words(ws):
    n = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    return len({i + j for i in range(len(ws) - 2) if n[tuple(ws[i : i + 3])] > 1 for j in range(3)})


def plain(text):
    t = text or ""
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeat_words(ws)


def check(df):
    rows = quality_rules.apply_rules(df, order=[n for n, _ in quality_rules.RULES]).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(r.text), r.doc_id
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    return rows


def test_statistics(sample, odd):
    check(sample)
    assert len(check(odd)) == 9


def test_small_arrays(spark):
    texts = ["a", "a b", "a b c", "a b c a b c", "a a a a", "x a b c y a b c a b c", "a\nb\na\n\na", "# # |\n<>", "a b \x0bc\x1cd"]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_order_never_changes_the_verdict(sample):
    names = [n for n, _ in quality_rules.RULES]
    a = {r.doc_id: r.kept for r in quality_rules.apply_rules(sample, order=names).select("doc_id", "kept").collect()}
    b = {r.doc_id: r.kept for r in quality_rules.apply_rules(sample, order=names[::-1]).select("doc_id", "kept").collect()}
    assert a == b
    assert sorted(quality_rules.cascade_order(sample, sample_rows=100)) == sorted(names)


def test_junk_goes_clean_stays(spark):
    clean = " ".join(f"word{i} of{i % 7} page{i % 5}" for i in range(60))
    junk = [" | ".join(f"w{i}" for i in range(80)), "\n".join(["same line of words here"] * 30), " ".join(f"WORD{i}!!" for i in range(80)), "few words"]
    df = spark.createDataFrame([(0, clean), *enumerate(junk, 1)], "doc_id long, text string")
    assert {r.doc_id for r in quality_rules.apply_rules(df).where("kept").collect()} == {0}


def test_clashing_names_and_empty(clashing, none):
    assert quality_rules.apply_rules(clashing).where(F.col("n_words") >= 0).count() == 9
    assert quality_rules.apply_rules(none).count() == 0


def test_no_python_in_the_plan(sample):
    plan = quality_rules.apply_rules(sample)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_oracle(spark):
    got = sorted(map(str, map(tuple, queries.op2_quality_rules(spark, "/root/testdata/sf0.001").collect())))
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    assert got == sorted(map(str, con.sql(queries.oracle_sql()["op2_quality_rules"]).fetchall()))


def test_cascade_keeps_what_the_statistics_say(sample, odd, clashing, none):
    names = [n for n, _ in [*quality_rules.BASE, *quality_rules.RULES]]
    for df in (sample, odd):
        want = sorted(str(r.doc_id) for r in quality_rules.apply_rules(df, order=[n for n, _ in quality_rules.RULES]).where("kept").collect())
        for order in (names, names[::-1], None):
            assert sorted(str(r.doc_id) for r in quality_rules.keep(df, order=order).collect()) == want
    own = clashing.withColumns({c: F.lit(c) for c in ("_w", "_l", "hit", "c0", "_keep")})
    assert quality_rules.keep(own).columns == own.columns
    assert set(own.columns) <= set(quality_rules.with_stats(own).columns)
    assert quality_rules.keep(none).count() == 0


def test_cascade_computes_each_statistic_once_and_lazily(sample):
    plan = quality_rules.keep(sample, order=["symbols", "repeated_words"])._jdf.queryExecution().executedPlan().toString()
    generate = next(x for x in plan.split("\n") if "Generate" in x)
    assert generate.count("xxhash64") == generate.count("sort_array(transform") == 1 and "CASE WHEN" in generate
    assert "Python" not in plan and "Exchange" not in plan and "xxhash64" not in "".join(x for x in plan.split("\n") if "Filter" in x)
