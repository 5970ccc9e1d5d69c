from pyspark.sql import functions as F

from millrace.operators import evaluate, links


def alarm_frame(spark, spans):
    return spark.createDataFrame([("s", f"a{i}", "kg_threshold_warning", "R", a, b, a) for i, (a, b) in enumerate(spans)], "entity string, alarm_id string, kind string, rule_id string, trigger_at long, last_positive_at long, run_start long")


def test_sessions_merge_at_the_gap_itself(spark):
    for spans, n in (([(0, 10), (20, 30)], 1), ([(0, 10), (21, 30)], 2), ([(0, 100), (5, 6), (105, 110)], 1)):
        assert links.sessions(alarm_frame(spark, spans), 10, tie=("alarm_id",)).select("session").distinct().count() == n


def test_overlap_join_finds_pairs_once(spark):
    a = spark.createDataFrame([("s", 1, 0, 500_000), ("s", 2, 600_000, 600_001)], "entity string, i long, a long, b long")
    b = spark.createDataFrame([("s", 7, 100_000, 400_000), ("s", 8, 500_000, 600_000), ("x", 9, 0, 10)], "entity string, j long, c long, d long")
    got = sorted((r.i, r.j) for r in links.overlap_join(a, b, "a", "b", "c", "d").collect())
    assert got == [(1, 7), (1, 8), (2, 8)]
    assert sorted(r.i for r in links.overlap_join(a, b, "a", "b", "c", "d", how="left_semi").collect()) == [1, 2]


def test_as_of_takes_the_latest_cause_within_reach(spark):
    e = spark.createDataFrame([("e1", "y", 1000), ("e2", "y", 5000)], "effect_id string, effect string, start long")
    c = spark.createDataFrame([("c1", "x", 400), ("c2", "x", 900), ("c3", "x", 1001), ("c4", "x", 3999)], "cause_id string, cause string, cause_start long")
    p = spark.createDataFrame([("x", "y", 1000)], "cause string, effect string, within long")
    assert [(r.effect_id, r.cause_id, r["lag"]) for r in links.as_of(e, c, p).collect()] == [("e1", "c2", 100)]
    at_reach = spark.createDataFrame([("c5", "x", 4000)], "cause_id string, cause string, cause_start long")
    assert links.as_of(e, at_reach, p).first().effect_id == "e2"


def test_severity_tags_raise_only(spark):
    a = alarm_frame(spark, [(0, 1)]).withColumn("session", F.lit(1))
    for tag, want in (("CRITICAL", "CRITICAL"), (None, "WARNING"), ("WARNING", "WARNING")):
        assert links.incidents(a.withColumn("tag", F.lit(tag).cast("string")), tag="tag").first().severity == want


def test_types_by_priority(spark):
    def kind(*alarms):
        rows = [("s", 1, k, "R", a, b) for k, a, b in alarms]
        return links.classify(spark.createDataFrame(rows, "entity string, session long, kind string, rule_id string, trigger_at long, last_positive_at long")).first().anomaly_type

    assert kind(("sop002_stuck_std", 0, 9), ("kg_threshold_critical", 0, 1)) == "STUCK"
    assert kind(("kg_threshold_critical", 0, 299)) == "SPIKE"
    assert kind(("kg_threshold_critical", 0, 300)) == "UNCLASSIFIED"
    assert kind(("kg_maint_drift", 0, 9), ("kg_threshold_warning", 5, 9)) == "DRIFT"
    assert kind(("kg_maint_drift", 7, 9), ("sop002_out_of_range", 5, 9)) == "OUT_OF_RANGE"


def test_matchings(spark):
    import itertools

    import numpy as np

    pairs = spark.createDataFrame([("s", "a", "x"), ("s", "a", "y"), ("s", "b", "x"), ("t", "c", "z")], "entity string, found_id string, gold_id string")
    assert evaluate.one_to_one(pairs).count() == 3
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, m = rng.integers(1, 5, 2)
        s = rng.uniform(-1, 1, (n, m)).round(2)
        ok = s >= 0.1
        best = (0, 0.0)
        for k in range(min(n, m) + 1):
            for rows in itertools.combinations(range(n), k):
                for cols in itertools.permutations(range(m), k):
                    if all(ok[i, j] for i, j in zip(rows, cols, strict=True)):
                        best = max(best, (k, round(sum(s[i, j] for i, j in zip(rows, cols, strict=True)), 6)))
        got = evaluate.best_assignment(np.where(ok, s, 0.0), ok)
        assert (len(got), round(sum(s[i, j] for i, j in got), 6)) == best
        assert len({i for i, _ in got}) == len(got) == len({j for _, j in got})


def test_assignment_prefers_more_pairs(spark):
    for scores, want in (([[1.0, 0.60], [0.60, 0.59]], 2), ([[0.9, 0.8], [0.59, -0.9]], 1)):
        rows = [("d", i, j, x) for i, r in enumerate(scores) for j, x in enumerate(r)]
        assert evaluate.assign(spark.createDataFrame(rows, "doc string, a long, b long, score double"), 0.6).count() == want
