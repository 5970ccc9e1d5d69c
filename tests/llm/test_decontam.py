import hashlib
import re

import pytest

from millrace.llm import decontam


def words(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def plain(docs, bench, width=13):
    windows = {}
    for i, t in bench:
        w = words(t)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    items |= own
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 3000, "block_bytes": 900}])
def test_equals_brute_force(spark, sample, options):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = decontam.scan(sample, bench, **options).drop("matches").collect()
    assert sorted(map(tuple, got), key=str) == plain([(r.doc_id, r.text) for r in sample.collect()], [(r.item_id, r.text) for r in bench.collect()])


def test_odd_rows(spark, odd, none, clashing):
    bench = [(1, "cat sat on the mat"), (2, None), (3, ""), (4, "!!!"), (5, "The CAT, sat"), (5, "delta"), (None, "ünïcode"), (6, "alpha beta gamma delta " * 9)]
    b = spark.createDataFrame(bench, "item_id long, text string")
    want = plain([(r.doc_id, r.text) for r in odd.collect()], [("" if i is None else i, t) for i, t in bench])
    for df in (odd, clashing):
        assert sorted(map(tuple, decontam.scan(df, b).drop("matches").collect()), key=str) == want
    clean = decontam.remove(clashing, b)
    assert clean.columns == clashing.columns
    assert sorted((r.doc_id for r in clean.select("doc_id").collect()), key=str) == sorted((r[0] for r in want if not r[-1]), key=str)
    assert decontam.scan(none, b).count() == 0
    assert decontam.scan(odd, b.where("item_id < 0")).where("contaminated").count() == 0


def test_longest_matches(spark):
    item = " ".join(f"w{i}" for i in range(40))
    doc = "x y " + " ".join(f"W{i}" for i in range(5, 30)) + " z " + " ".join(f"w{i}" for i in range(12))
    r = decontam.scan(spark.createDataFrame([(1, doc)], "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).first()
    assert [tuple(m) for m in r.matches] == [("7", 5, 2, 25)] and r.n_hit == 25
