import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import series

STEP = 30


def frame(spark, rows):
    return spark.createDataFrame([("s", t * STEP, float(v)) for t, v in rows], "entity string, t long, v double")


def alarms(spark, rows, cond, duration=0):
    r = series.with_runs(series.with_segments(frame(spark, rows), STEP), cond)
    return sorted((a.trigger_at // STEP, a.last_positive_at // STEP, a.positive_samples) for a in series.persistent(r, F.lit(duration)).collect())


def test_limit_itself_is_no_violation(spark):
    assert alarms(spark, [(0, 10.0), (1, 10.0)], "v > 10") == []


def test_duration_is_strict(spark):
    held = [(k, 11.0) for k in range(11)]
    assert alarms(spark, held, "v > 10", 300) == []
    assert alarms(spark, [*held, (11, 11.0)], "v > 10", 300) == [(11, 11, 1)]


def test_gap_resets_persistence(spark):
    rows = [(k, 11.0) for k in range(8)] + [(k, 11.0) for k in range(9, 20)]
    assert alarms(spark, rows, "v > 10", 300) == []


def test_stuck_needs_eleven(spark):
    ten, eleven = [(k, 5.0) for k in range(10)], [(k, 5.0) for k in range(11)]
    for rows, n in ((ten, 0), (eleven, 1)):
        assert series.stuck_exact(series.with_segments(frame(spark, rows), STEP), 11, STEP).count() == n


def loop_model(rows, duration):
    """Alarms of v > 5 by a plain loop."""
    out, last, start, alarm = [], None, None, None
    for t, v in rows:
        if last is not None and t - last != 1:
            start, alarm = None, None
        if v > 5:
            start = t if start is None else start
            if duration == 0 or (t - start) * STEP > duration:
                if alarm is None:
                    alarm = [t, t, 0]
                    out.append(alarm)
                alarm[1], alarm[2] = t, alarm[2] + 1
        else:
            start, alarm = None, None
        last = t
    return sorted(map(tuple, out))


@pytest.mark.parametrize("duration", [0, 60])
def test_random_walk_equals_loop(spark, duration):
    rnd = random.Random(duration)
    rows, t = [], 0
    for _ in range(400):
        t += 1 if rnd.random() < 0.93 else 3
        rows.append((t, rnd.randint(0, 10)))
    assert alarms(spark, rows, "v > 5", duration) == loop_model(rows, duration)


def test_future_values_do_not_move_a_trigger(spark):
    rnd = random.Random(3)
    rows = [(k, rnd.randint(0, 10)) for k in range(120)]
    full = {a[0] for a in alarms(spark, rows, "v > 5", 30)}
    for cut in (40, 80):
        assert {a[0] for a in alarms(spark, rows[:cut], "v > 5", 30)} == {t for t in full if t < cut}


def test_rolling_features_need_a_full_segment(spark):
    rows = [(k, float(k)) for k in range(4)] + [(k, float(k)) for k in range(6, 12)]
    out = series.rolling_slope(series.rolling_std(series.with_segments(frame(spark, rows), STEP), 5), 5).where("std IS NOT NULL").collect()
    assert sorted(r.t // STEP for r in out) == [10, 11]
    assert all(abs(r.slope_per_step - 1) < 1e-9 for r in out)


def test_robust_sigma_falls_back(spark):
    r = series.robust_sigma(frame(spark, [(k, 1.0) for k in range(9)] + [(9, 11.0)])).first()
    assert abs(r.sigma - 3.0) < 1e-9 and r.samples == 10
