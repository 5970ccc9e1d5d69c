import hashlib
import re

import pytest

from millrace.llm import substring_dedup as S


def plain(rows, width):
    docs = [(d, [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for d, t in rows]
    key = lambda d, i: (-1 if d is None else d, i)
    first = {}
    for d, ws in docs:
        for i in range(len(ws) - width + 1):
            g = tuple(ws[i : i + width])
            first[g] = min(first.get(g, key(d, i)), key(d, i))
    out = []
    for d, ws in docs:
        gone = {i + j for i in range(len(ws) - width + 1) if first[tuple(ws[i : i + width])] < key(d, i) for j in range(width)}
        out.append((d, len(ws), len(gone), hashlib.sha256(" ".join(w for i, w in enumerate(ws) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 5_000, "bucket_windows": 500}])
def test_equals_brute_force(sample, options):
    got = sorted(map(tuple, S.deduplicate(sample, **options).collect()), key=str)
    assert got == plain([(r.doc_id, r.text) for r in sample.collect()], 20)
    assert sum(r[2] for r in got) > 0


def test_odd_rows(odd, none, clashing):
    want = plain([(r.doc_id, r.text) for r in odd.collect()], 20)
    for df in (odd, clashing):
        for options in ({}, {"chunk_bytes": 100}):
            assert sorted(map(tuple, S.deduplicate(df, **options).collect()), key=str) == want
    assert S.deduplicate(none).count() == 0


def test_factors_and_text(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(1, a), (2, b), (3, f"x {a} y {b} z"), (4, " ".join(a.split()[:19]))], "doc_id long, text string")
    assert sorted(map(tuple, S.factors(df).collect())) == [(3, 1, 30, 1, 0), (3, 32, 30, 2, 0)]
    out = {r.doc_id: r for r in S.deduplicate(df, with_text=True).collect()}
    assert out[3].kept_text == "x y z" and out[3].n_removed == 60 and out[4].n_removed == 0


def passages(seed, n_docs):
    """Documents that share passages of 15 to 60 words, phrases in varying company, and repeated ids."""
    import random

    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(300)}"
    pool = [[word() for _ in range(rnd.randint(15, 60))] for _ in range(8)]
    phrase = [word() for _ in range(9)]
    rows = []
    for d in range(n_docs):
        ws = []
        for _ in range(rnd.randint(0, 6)):
            ws += [word() for _ in range(rnd.randint(0, 25))]
            p = rnd.choice(pool)
            k = rnd.randrange(len(p) // 2)
            ws += rnd.choice([p, p[k:], p[: len(p) - k], phrase])
        rows.append((None if d % 17 == 5 else d if d % 11 else d + 3, " ".join(ws)))
    rows += rnd.sample(rows, 6)
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_boundaries_and_recurring_anchors(spark, seed):
    rows = passages(seed, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for options in ({}, {"chunk_bytes": 700, "bucket_windows": 100}):
        assert sorted(map(tuple, S.deduplicate(df, **options).collect()), key=str) == plain(rows, 20)


def test_factors_hold_the_words_of_earlier_documents(spark):
    rows = [(i, t) for i, (_, t) in enumerate(passages(9, 60))]
    words = dict((d, t.split()) for d, t in rows)
    found = S.factors(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=900).collect()
    assert len(found) > 20
    for f in found:
        assert f.words >= 20 and (f.source_doc, f.source_start) < (f.doc_id, f.start)
        assert words[f.doc_id][f.start : f.start + f.words] == words[f.source_doc][f.source_start : f.source_start + f.words]


def test_rows_grow_with_the_input(spark, monkeypatch):
    """What blocks tell the directory grows in proportion, whatever the number of blocks."""
    import random

    from pyspark.sql import functions as F

    counts = []
    for times in (1, 2, 4):
        rnd = random.Random(1)
        common = " ".join(f"c{i}" for i in range(40))
        rows = [(i, " ".join(f"w{rnd.randrange(5000)}" for _ in range(150)) + " " + common) for i in range(60 * times)]
        docs = spark.createDataFrame(rows, "d long, t string").select("d", F.col("t").cast("binary").alias("t")).coalesce(1)
        blocks = S._blocks(docs, 3_000)
        counts.append((blocks.count(), S._directory(blocks, 20).count()))
    (b1, n1), (b2, n2), (b4, n4) = counts
    assert b4 > 3.5 * b1 and n2 < 2.1 * n1 and n4 < 4.2 * n1
