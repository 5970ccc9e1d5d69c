import random
from itertools import combinations

import xxhash
from pyspark.sql import functions as F

from millrace.llm import graph, simhash


def fingerprint(text):
    w = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain(rows):
    fps = [(d, fingerprint(t)) for d, t in rows]
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
            parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(fps):
        low.setdefault(root(i), []).append(d)
    name = {r: min((d for d in ds if d is not None), default=None) for r, ds in low.items()}
    return sorted(((d, f"{f:016x}", name[root(i)]) for i, (d, f) in enumerate(fps)), key=str)


def test_equals_brute_force(sample):
    got = sorted(map(tuple, simhash.near_duplicates(sample).collect()), key=str)
    assert got == plain([(r.doc_id, r.text) for r in sample.collect()])


def test_odd_rows(odd, none, clashing):
    want = plain([(r.doc_id, r.text) for r in odd.collect()])
    assert sorted(map(tuple, simhash.near_duplicates(odd).collect()), key=str) == want
    assert sorted(map(tuple, simhash.near_duplicates(clashing).collect()), key=str) == want
    assert simhash.near_duplicates(none).count() == 0


def test_every_pair_within_the_radius_collides():
    for radius in (1, 2, 3):
        masks = simhash.covering_masks(radius)
        rnd = random.Random(radius)
        for _ in range(500):
            x, flips = rnd.getrandbits(64), rnd.sample(range(64), radius)
            y = x
            for b in flips:
                y ^= 1 << b
            assert any((x ^ y) & m == 0 for m in masks)


def test_large_buckets_lose_no_link(spark):
    rnd = random.Random(9)
    fps = {rnd.getrandbits(64) for _ in range(40)}
    for x in list(fps):
        for _ in range(6):
            for b in rnd.sample(range(64), 2):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >= 1 << 63 else f, i) for i, f in enumerate(fps)], "fp long, rep long")

    def classes(limit):
        comp = {r.node: r.component for r in graph.components(simhash.links(df, bucket_limit=limit)).collect()}
        return [comp.get(i, i) for i in range(len(fps))]

    want = list(range(len(fps)))
    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2 and want[i] != want[j]:
            a, b = sorted((want[i], want[j]))
            want = [a if x == b else x for x in want]
    assert classes(4096) == want == classes(3)


def test_components(spark):
    e = [(i, i + 1) for i in range(30)] + [(100, 140), (140, 120), (7, 7), (3, 1)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(e, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 120: 100, 140: 100}
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_one_of_each_group_stays(odd):
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 5, None, 7], key=str)
    assert kept.where(F.col("doc_id") == 1).count() == 1


def test_ids_at_both_ends(spark):
    big = 1 << 62
    ids = [big + 5, big - 1, (1 << 63) - 1, -(1 << 63), -1, 0, None, None]
    texts = ["one two three four"] * 2 + ["five six seven eight"] * 2 + ["nine ten eleven", "twelve", "lone row without id", "lone row without id"]
    rows = list(zip(ids, texts, strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str) == plain(rows)
    assert sorted((r.doc_id for r in simhash.deduplicate(df).collect()), key=str) == sorted([big - 1, -(1 << 63), -1, 0, None], key=str)


def test_clashing_columns(odd):
    own = odd.withColumns({c: F.lit(c) for c in ("_stay", "component", "component_id", "_lone", "_key", "c0", "c1", "fp", "_fp")})
    kept = simhash.deduplicate(own)
    assert kept.columns == own.columns
    assert kept.where("_stay = '_stay' AND component = 'component' AND c0 = 'c0'").count() == kept.count() == 5
