import random
from itertools import combinations

import corpus_pipeline
from millrace.llm import near_copies

SCHEMA = "doc_id long, text string"


def shingles(text):
    w = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def plain(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if label[i] != label[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    return sorted({d: min(e for (e, _), y in zip(rows, label, strict=True) if x == y) for (d, _), x in zip(rows, label, strict=True)}.items())


def planted():
    """Copies with 1 to 12 words changed, of short and long texts, in chains, with a common line."""
    rnd = random.Random(3)
    word = lambda: f"w{rnd.randrange(4000)}"
    line = [word() for _ in range(30)]
    rows = []
    for size in (6, 40, 90, 200, 400):
        for _ in range(6):
            w = [word() for _ in range(size)] + line
            for _ in range(8):
                rows.append((len(rows), " ".join(w)))
                w = list(w)
                for _ in range(rnd.randint(1, max(1, size // 40))):
                    w[rnd.randrange(len(w))] = word()
    return rows


def test_equals_brute_force(spark):
    rows = planted()
    want = plain(rows)
    assert 30 < len({c for _, c in want}) < len(rows) - 30
    df = spark.createDataFrame(rows, SCHEMA)
    for options in ({}, {"bucket_limit": 7, "most": 5}):
        got = near_copies.near_duplicates(df, **options).select("doc_id", "component_id").collect()
        assert sorted(map(tuple, got)) == want


def test_stage_drops_near_copies_and_no_others(spark):
    """Fails with op8's fingerprints, which link few pairs of 0.8."""
    rows = planted()
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in plain(rows)})


def test_sample_equals_brute_force(spark, sample):
    got = sorted(map(tuple, near_copies.near_duplicates(sample).select("doc_id", "component_id").collect()))
    assert got == plain([(r.doc_id, r.text) for r in sample.collect()])


def test_one_of_each_group_stays(odd, none):
    kept = near_copies.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 5, None, 7], key=str)
    assert near_copies.deduplicate(none).count() == 0


def test_ids_at_both_ends_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    words = [f"w{i}" for i in range(30)]
    near = " ".join([*words, "x"])
    rows = [((1 << 63) - 1, " ".join(words)), ((1 << 62) + 3, near), (-(1 << 63), "other words altogether here now"), (None, "a lone row that has no id"), (None, "a lone row that has no id")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in ("_stay", "_th", "th", "component", "_lone", "c0")})
    kept = near_copies.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([(1 << 62) + 3, -(1 << 63), None], key=str)


def test_candidates_come_from_simhash(spark, monkeypatch):
    """Fails where the stage links nothing by fingerprints (F3); what they link is right, and not all there is."""
    rows = planted()
    want, seen, found = dict(plain(rows)), [], near_copies._by_simhash

    def watched(scratch, nodes, raw, *more):
        ids = {r.fp: r.low for r in nodes.collect()}
        out = found(scratch, nodes, raw, *more)
        seen.extend((ids[r.src], ids[r.dst]) for r in out.collect())
        return out

    monkeypatch.setattr(near_copies, "_by_simhash", watched)
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert seen and all(want[a] == want[b] for a, b in seen)
