import numpy as np
from pyspark.sql import functions as F

from millrace.llm import ordinal


def grades(spark, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return labels.select("doc_id", F.expr("CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END").alias("grade"))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    g = grades(spark, folder)
    test = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    model = ordinal.fit(docs, g.where(~test), 3)
    rows = ordinal.score(docs, model).join(g.where(test), "doc_id").collect()
    kept = {k: np.mean([r.kept for r in rows if r.grade == k]) for k in range(3)}
    assert kept[2] > 0.95 and kept[1] < 0.25 and kept[0] < 0.4
    mean = {k: np.mean([r.expected_grade for r in rows if r.grade == k]) for k in range(3)}
    assert mean[2] > max(mean[0], mean[1])
    assert all(np.diff(model.thresholds) > 0)


def test_gradients_point_downhill():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 50, 8)) for _ in range(400)]
    worth = rng.normal(size=50)
    s = np.array([worth[r].sum() for r in rows])
    y = (s > -1).astype(int) + (s > 1)
    p = {e: np.mean(np.log(ordinal.fit_rows(rows, y, 3, epochs=e).probabilities(np.array([ordinal.fit_rows(rows, y, 3, epochs=e).weights[r].sum() for r in rows]))[np.arange(len(y)), y])) for e in (1, 12)}
    assert p[12] > p[1] > -1.1


def test_odd_rows(spark, odd, none, clashing):
    g = spark.createDataFrame([(1, 2), (5, 0), (7, 1), (6, 2), (6, 1), (99, 1), (None, 1), (2, None)], "doc_id long, grade int")
    m = ordinal.fit(odd, g, 3)
    rows = ordinal.score(odd, m).collect()
    assert len(rows) == 9 and all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in rows)
    assert ordinal.score(clashing, m).count() == 9 and ordinal.score(none, m).count() == 0
    assert len(ordinal.fit(none, g, 3).thresholds) == 2
    assert len(ordinal.fit(odd, g.where("grade = 2"), 3).thresholds) == 2
    assert ordinal.fit(odd, g, 3, max_rows=2).weights.shape == m.weights.shape


def loss(w, t, rows, y):
    s = np.array([w[r].sum() for r in rows])
    below = 1 / (1 + np.exp(-(t[None, :] - s[:, None])))
    p = np.diff(np.concatenate([np.zeros((len(y), 1)), below, np.ones((len(y), 1))], axis=1), axis=1)
    return -np.log(p[np.arange(len(y)), y]).mean()


def test_first_step_follows_the_plain_gradient():
    """One batch, one epoch: a weight's step tells its gradient, which finite differences give too."""
    rng = np.random.default_rng(6)
    rows = [np.unique(rng.integers(0, 12, 5)) for _ in range(100)]
    y = rng.integers(0, 3, 100)
    rate = 0.15
    got = ordinal.fit_rows(rows, y, 3, epochs=1, rate=rate, l2=0.0).weights[:12]
    share = np.cumsum(np.bincount(y, minlength=3) + 0.5)[:-1] / (len(y) + 1.5)
    t, w = np.log(share / (1 - share)), np.zeros(12)
    for k in range(12):
        step = np.zeros(12)
        step[k] = 1e-5
        g = (loss(w + step, t, rows, y) - loss(w - step, t, rows, y)) / 2e-5
        assert np.isclose(got[k], -rate * g / np.sqrt(1e-6 + g * g), atol=1e-4)


def test_scores_equal_the_plain_model(sample):
    model = ordinal.Model(np.random.default_rng(1).normal(size=1 << ordinal.BITS) / 30, np.array([-0.4, 0.6]))
    texts = {r.doc_id: r.text for r in sample.collect()}
    for r in ordinal.score(sample, model).collect():
        s = model.weights.astype(np.float32)[list(ordinal.features(texts[r.doc_id], {}))].sum(dtype=np.float64)
        below = 1 / (1 + np.exp(-(model.thresholds - s)))
        assert np.isclose(r.tail_probability, 1 - below[1]) and np.isclose(r.expected_grade, 2 - below.sum())
        assert r.kept == (r.tail_probability >= 0.5)


def test_clashing_columns_of_documents(spark, odd):
    g = spark.createDataFrame([(1, 2), (5, 0), (7, 1)], "doc_id long, grade int")
    own = odd.withColumns({c: F.lit(c) for c in ("grade", "_id", "f", "_doc")})
    assert np.array_equal(ordinal.fit(own, g, 3).thresholds, ordinal.fit(odd, g, 3).thresholds)
