import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing


def test_targets_fill_up():
    assert np.allclose(mixing.targets([10, 10, 10], [5, 2, 1]), [18.75, 7.5, 3.75])
    t = mixing.targets([1, 100, 100], [5, 2, 1])
    assert t[0] == 3 and math.isclose(sum(t), 201) and math.isclose(t[1] / t[2], 2)
    assert mixing.targets([0, 0], [5, 2]) == [0.0, 0.0] and mixing.targets([], []) == []


def test_pivot_keeps_words():
    rng = np.random.default_rng(2)
    size, p = rng.integers(1, 500, 400).astype(float), rng.uniform(0, 1, 400)
    out, held = mixing._pivot(size, p, rng.uniform(0, 1, 400))
    assert np.isin(np.delete(out, held) if held >= 0 else out, (0.0, 1.0)).all()
    assert abs((size * out).sum() - (size * p).sum()) < 1e-6 * size.sum()


def test_pivot_keeps_each_probability():
    size, p = np.array([3.0, 5.0, 2.0]), np.array([0.3, 0.6, 0.5])
    rng = np.random.default_rng(3)
    mean = np.mean([mixing._pivot(size, p, rng.uniform(0, 1, 3))[0] for _ in range(20_000)], axis=0)
    assert np.allclose(mean, p, atol=0.02)


@pytest.mark.parametrize("options", [{}, {"part_rows": 3}])
def test_sources_come_near_their_targets(sample, options):
    rows = sample.select("doc_id", "source").join(mixing.mix(sample, **options), "doc_id").collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert r.taken == r.copies * r.size <= 3 * r.size
    for rs in by.values():
        assert sum(r.size for r in rs) == rs[0].source_size
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(r.size for r in rs)
    assert math.isclose(sum(rs[0].target for rs in by.values()), sum(r.size for r in rows))


def test_reruns_agree(sample):
    a = sorted(map(tuple, mixing.mix(sample, part_rows=5).collect()))
    assert a == sorted(map(tuple, mixing.mix(sample.repartition(7), part_rows=5).collect()))


def test_deep_trees(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), F.col("id").alias("k"), (F.col("id") % 90 + 1).alias("size"), F.lit(0.37).alias("p"))
    out = mixing.round_dependently(df, part_rows=10, fan_in=4)
    for g in range(2):
        r = out.where(F.col("g") == g).agg(F.sum(F.col("size") * F.col("one")), F.sum("size"), F.count("*")).first()
        assert abs(r[0] - 0.37 * r[1]) <= 90 and r[2] == 1500


def test_odd_rows(odd, none, clashing):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 9 and {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, 7, None}
    assert all(r.size == r.taken == 0 for r in rows if r.doc_id in (2, 3, 4))
    assert sorted(map(str, mixing.mix(clashing).collect())) == sorted(map(str, rows))
    assert mixing.mix(none).count() == 0


def test_rows_alike_are_dealt_to_many_parts(spark):
    rows = [(None, "a b c", "s")] * 900 + [(7, "a b", "s")] * 300 + [(i, "x " * (i % 9), "t") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = mixing.with_size(docs).select("doc_id", "source", "size")
    numbered = mixing._numbered(sized, 50)
    assert numbered.count() == len(rows) == numbered.distinct().count()
    out = mixing.mix(docs, part_rows=50)
    assert out.count() == len(rows)
    for size, target in out.groupBy("source_size").agg(F.sum("taken"), F.first("target")).select("sum(taken)", "first(target)").collect():
        assert abs(size - target) <= 9
    again = mixing.mix(docs.repartition(5), part_rows=50)
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, map(tuple, again.collect())))


def test_many_sources_equal_the_plain_targets(spark):
    rng = np.random.default_rng(4)
    names = [None, "", "é", "z", "\U0001f600", "￿"] + [f"host{i}" for i in range(300)]
    sizes = {n: int(rng.integers(0, 40)) if k % 3 else int(rng.integers(200, 9000)) for k, n in enumerate(names)}
    df = spark.createDataFrame([(n, s) for n, s in sizes.items()], "source string, size long").repartition(5)
    order = sorted(names, key=lambda n: (n is None, (n or "").encode()))
    want = dict(zip(order, mixing.targets([sizes[n] for n in order], [(5, 2, 1)[k % 3] for k in range(len(order))]), strict=True))
    got = {r.name: r for r in mixing.source_targets(df).collect()}
    assert [got[n].g for n in order] == list(range(len(order)))
    assert all(math.isclose(got[n].target, want[n], rel_tol=1e-9, abs_tol=1e-9) for n in order)
