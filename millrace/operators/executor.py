"""Rules of every kind in one normal form, and their execution over a series in one pass.

A rule is a row: rule_id, kind (of the alarm), entity, executor, and the parameters that its executor
reads. `execute` computes each window feature once for each length that some rule asks for, all over
one partitioning by entity and one order, then joins the rules of an entity to its samples, so that
conditions, runs and triggers of all kinds share one shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules as R
from . import series as S

EXECUTORS = ("threshold_scan", "slope", "stuck_std", "outside_run", "window_change", "sustained_from_nominal", "partial_threshold")
RULE = "rule_id string, kind string, entity string, executor string, op string, value double, second double, duration long, window int, readings int, nominal double, flag string"


def normalise(*parts: DataFrame) -> DataFrame:
    """Rule tables of any of RULE's columns as one table of them all; what a part lacks is null. Rules of
    unknown executors raise when they are read, as no condition can be given for them."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    names = dict(c.split() for c in RULE.split(", "))
    out = out.select(*[(F.col(c) if c in out.columns else F.lit(None)).cast(t).alias(c) for c, t in names.items()])
    known = F.col("executor").isin(*EXECUTORS)
    return out.withColumn("executor", F.when(known, F.col("executor")).otherwise(F.raise_error(F.concat(F.lit("unknown executor "), F.coalesce("executor", F.lit("null"))))))


def _feature(wanted: dict[str, list[int]], executor: str, name: str) -> Column:
    """The feature of the rule's own window length."""
    out = F.lit(None).cast("double")
    for n in wanted.get(executor, []):
        out = F.when(F.col("window") == n, F.col(f"{name}_{n}")).otherwise(out)
    return out


def _condition(wanted: dict[str, list[int]]) -> Column:
    v, value, nominal = F.col("v"), F.col("value"), F.col("nominal")
    slope, fitted = _feature(wanted, "slope", "slope"), _feature(wanted, "slope", "fitted")
    now, before = _feature(wanted, "window_change", "now"), _feature(wanted, "window_change", "before")
    by = {
        "threshold_scan": R.violates(F.col("op"), v, value, F.col("second")),
        "slope": (F.col("sigma") > 0) & (F.abs(slope) > value * F.col("sigma")) & (F.signum(fitted - nominal) == F.signum(slope)),
        "stuck_std": _feature(wanted, "stuck_std", "std") < value,
        "outside_run": (v < value) | (v > F.col("second")),
        "window_change": (F.abs(now - before) > value) & (F.abs(now - nominal) > F.abs(before - nominal)),
        "sustained_from_nominal": F.abs(v - nominal) > value,
        "partial_threshold": R.violates(F.col("op"), v, value),
    }
    out = F.lit(None).cast("boolean")
    for name, c in by.items():
        out = F.when(F.col("executor") == name, c).otherwise(out)
    return out


def execute(samples: DataFrame, rules: DataFrame, sigma: DataFrame | None, step: int, smooth: int = 2) -> DataFrame:
    """Alarms of normalise() rules over with_segments() samples(entity, t, v, gap, pos). sigma(entity,
    sigma) calibrates slopes; without one a slope rule has no alarm. A rule's alarm is one run of its
    condition: a threshold fires when the run has lasted strictly longer than `duration` (at once if 0),
    every other kind at the run's `readings`-th sample (the first if null)."""
    lengths: dict[str, list[int]] = {}
    for r in rules.where("window IS NOT NULL").select("executor", "window").distinct().collect():  # of the rule table
        lengths.setdefault(r.executor, []).append(r.window)
    x = samples
    for n in lengths.get("slope", []):
        x = S.rolling_slope(x, n).withColumnsRenamed({"slope_per_step": f"slope_{n}", "fitted_end": f"fitted_{n}"})
    for n in lengths.get("stuck_std", []):
        x = S.rolling_std(x, n).withColumnRenamed("std", f"std_{n}")
    for n in lengths.get("window_change", []):
        x = S.window_change(x, n, smooth).withColumnsRenamed({"now": f"now_{n}", "before": f"before_{n}"})
    key = ("entity", "rule_id")
    judged = x.join(rules, "entity")
    judged = judged.withColumn("sigma", F.lit(None).cast("double")) if sigma is None else judged.join(sigma.select("entity", "sigma"), "entity", "left")
    runs = S.with_runs(judged, _condition(lengths), key)
    nth = (F.col("t") - F.col("run_start")) / step + 1
    duration = F.coalesce("duration", F.lit(0))
    lasting = (duration == 0) | (F.col("t") - F.col("run_start") > duration)
    hits = runs.where("cond").where(F.when(F.col("executor") == "threshold_scan", lasting).otherwise(nth >= F.coalesce("readings", F.lit(1))))
    back = F.when(F.col("executor") == "stuck_std", (F.col("window") - 1) * step).otherwise(0)
    alarms = hits.groupBy(*key, "run_start").agg(
        F.first("kind").alias("kind"), F.first("flag").alias("flag"), (F.col("run_start") - F.first(back)).alias("condition_start"),
        F.min("t").alias("trigger_at"), F.max("t").alias("last_positive_at"), F.count("*").alias("positive_samples"), F.min(F.struct("t", "v"))["v"].alias("trigger_value"),
    )
    return alarms.withColumn("alarm_id", F.concat_ws("-", "rule_id", "entity", F.col("trigger_at").cast("string")))
