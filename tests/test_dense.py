"""Dense top-k against a plain version, with what a matrix product could get wrong."""

import math
import random

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import retrieval as R


def unit(v):
    n = math.sqrt(sum(x * x for x in v)) if v and None not in v else 0
    return [x / n for x in v] if n else None


def plain(rows, k):
    units = [(d, unit(v)) for d, v in rows]
    out = []
    for q, a in units:
        if q is not None and q % 25 == 0:
            scored = [(d, round(sum(x * y for x, y in zip(a, b, strict=True)), 6) if a and b and len(a) == len(b) else None) for d, b in units]
            scored.sort(key=lambda r: (r[1] is None, -(r[1] or 0), r[0] is not None, r[0] or 0))
            out += [(q, d, s, i + 1) for i, (d, s) in enumerate(scored[:k])]
    return sorted(out, key=str)


def test_equals_the_plain_version(spark):
    rnd = random.Random(5)
    some = [rnd.gauss(0, 1) for _ in range(8)]
    rows = [(i, some if i % 3 == 0 else [rnd.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    rows += [(None, some), (1000, None), (1001, []), (1025, [0.0] * 8), (1050, some[:5]), (1075, [1.0, None, 2.0]), (-25, some), (-(1 << 63), some)]
    df = spark.createDataFrame(rows, "doc long, e array<double>").repartition(5)
    v = df.select("doc", T.normalized(F.col("e")).alias("v"))
    q = v.where("doc % 25 = 0").select(F.col("doc").alias("query"), F.col("v").alias("q"))
    for most in (10_000, 7):
        got = R.dense_top_k(v, q, 6, most).select("query", "doc", F.round("score", 6), "rank").collect()
        assert sorted(map(tuple, got), key=str) == plain(rows, 6)


def test_pairs_are_never_rows(spark):
    """Fails where each pair is a row of the plan: its join gave 20,000 rows for 200 wanted (F2)."""
    v = spark.range(1000).select(F.col("id").alias("doc"), T.normalized(F.array(*[F.rand(i) - 0.5 for i in range(4)])).alias("v"))
    df = R.dense_top_k(v, v.where("doc % 50 = 0").select(F.col("doc").alias("query"), F.col("v").alias("q")), 10)
    assert df.count() == 200
    assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()


def test_halves_round_as_spark_does(spark):
    import numpy as np

    x = np.array([0.1234567895, -0.1234567895, 0.0000000005, 1.0, 0.9999999995, 0.5000000015, 0.123456789499999])
    want = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 9)).collect()]
    assert R._rounded(x, 9).tolist() == want
