"""Ordered series: contiguity, persistence, runs, rolling features and calibration.

A series has an entity (any key columns), a time t in seconds and a value v. All windows of an
operator share one partitioning (the key) and one order (t), so a chain of operators costs one
shuffle and one sort; positions and run lengths come from running maxima of start times rather than
from windows over window results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

KEY = ("entity",)


def _order(key: Sequence[str]):
    return W.partitionBy(*key).orderBy("t")


def _so_far(key: Sequence[str]):
    return _order(key).rowsBetween(W.unboundedPreceding, 0)


def seconds(ts: str | Column) -> Column:
    """Whole seconds since 1970 of a timestamp without time zone; no session zone is involved."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts) if isinstance(ts, str) else ts)


def grid(events: DataFrame, step: int, entity: str = "event_type", ts: str = "ts", value: str = "value") -> DataFrame:
    """Buckets of `step` seconds by entity: t, v (largest value) and n (rows)."""
    at = seconds(ts)
    return events.groupBy(F.col(entity).alias("entity"), (at - F.pmod(at, F.lit(step))).alias("t")).agg(F.max(value).alias("v"), F.count("*").alias("n"))


def with_segments(df: DataFrame, step: int, key: Sequence[str] = KEY, max_gap: bool = False) -> DataFrame:
    """Adds gap (first sample, or not `step` after the one before; with max_gap, more than step
    after), seg (number of the contiguous segment) and pos (place in it, from 1)."""
    w, upto = _order(key), _so_far(key)
    delta = F.col("t") - F.lag("t").over(w)
    gap = delta.isNull() | ((delta > step) if max_gap else (delta != step))
    out = df.withColumn("gap", gap).withColumn("seg", F.sum(F.col("gap").cast("long")).over(upto))
    if max_gap:
        n = F.row_number().over(w)
        return out.withColumn("_n", n).withColumn("pos", F.col("_n") - F.max(F.when(F.col("gap"), F.col("_n"))).over(upto) + 1).drop("_n")
    first = F.max(F.when(F.col("gap"), F.col("t"))).over(upto)
    return out.withColumn("pos", ((F.col("t") - first) / step).cast("long") + 1)


def with_runs(df: DataFrame, cond: str | Column, key: Sequence[str] = KEY) -> DataFrame:
    """Adds cond and run_start: the time of the first sample of the true run that a true sample
    stands in. A run ends at a false sample and at a gap (column `gap`)."""
    w, upto = _order(key), _so_far(key)
    c = F.expr(cond) if isinstance(cond, str) else cond
    out = df.withColumn("cond", F.coalesce(c, F.lit(False)))
    new = F.col("cond") & (F.col("gap") | ~F.coalesce(F.lag("cond").over(w), F.lit(False)))
    out = out.withColumn("_new", new)
    return out.withColumn("run_start", F.when(F.col("cond"), F.max(F.when(F.col("_new"), F.col("t"))).over(upto))).drop("_new")


def persistent(df: DataFrame, duration: str | Column = "0", key: Sequence[str] = KEY) -> DataFrame:
    """Alarms of with_runs() rows: one for each run that has a hit. A sample hits if its run has
    lasted strictly longer than `duration` seconds, or at once where that is 0."""
    d = F.expr(duration) if isinstance(duration, str) else duration
    hits = df.where(F.col("cond") & ((d == 0) | (F.col("t") - F.col("run_start") > d)))
    at = F.struct("t", "v")
    return hits.groupBy(*key, "run_start").agg(F.min("t").alias("trigger_at"), F.max("t").alias("last_positive_at"), F.count("*").alias("positive_samples"), F.min(at)["v"].alias("trigger_value"), F.min("v").alias("min_value"), F.max("v").alias("max_value"))


def counted_runs(df: DataFrame, min_count: int, step: int, offset: int = 0, key: Sequence[str] = KEY) -> DataFrame:
    """Alarms of with_runs() rows on an exact grid: the trigger is a run's min_count-th sample, the
    condition starts `offset` seconds before its first."""
    nth = (F.col("t") - F.col("run_start")) / step + 1
    hits = df.where(F.col("cond") & (nth >= min_count))
    return hits.groupBy(*key, "run_start").agg(F.min("t").alias("trigger_at"), F.max("t").alias("last_positive_at"), F.count("*").alias("positive_samples"), F.min(F.struct("t", "v"))["v"].alias("trigger_value")).withColumn("condition_start", F.col("run_start") - offset)


def stuck_exact(df: DataFrame, min_count: int, step: int, key: Sequence[str] = KEY, value: str = "v") -> DataFrame:
    """Alarms of with_segments() rows for min_count equal values in a row."""
    w, upto = _order(key), _so_far(key)
    out = df.withColumn("_new", F.col("gap") | ~F.col(value).eqNullSafe(F.lag(value).over(w)))
    out = out.withColumn("run_start", F.max(F.when(F.col("_new"), F.col("t"))).over(upto))
    nth = (F.col("t") - F.col("run_start")) / step + 1
    hits = out.where(nth >= min_count)
    return hits.groupBy(*key, "run_start", F.col(value).alias("stuck_value")).agg(F.min("t").alias("trigger_at"), F.max("t").alias("last_positive_at"), F.count("*").alias("positive_samples"))


def rolling_slope(df: DataFrame, n: int, key: Sequence[str] = KEY) -> DataFrame:
    """Adds slope (least squares, per minute) and fitted_end over the last n samples; null until the
    segment has n."""
    frame = _order(key).rowsBetween(-(n - 1), 0)
    # minutes since the segment began keep the sums small
    x = (F.col("pos") - 1) * F.lit(1.0)
    out = df.withColumn("_x", x)
    full = F.col("pos") >= n
    s = F.when(full, F.regr_slope("v", "_x").over(frame))
    out = out.withColumn("slope_per_step", s)
    return out.withColumn("fitted_end", F.when(full, F.avg("v").over(frame) + F.col("slope_per_step") * (n - 1) / 2)).drop("_x")


def rolling_std(df: DataFrame, n: int, key: Sequence[str] = KEY) -> DataFrame:
    """Adds std, the population deviation of the last n samples; null until the segment has n."""
    return df.withColumn("std", F.when(F.col("pos") >= n, F.stddev_pop("v").over(_order(key).rowsBetween(-(n - 1), 0))))


def window_change(df: DataFrame, back: int, smooth: int, key: Sequence[str] = KEY) -> DataFrame:
    """Adds now (mean of the last `smooth`) and before (mean of as many, `back` samples earlier)."""
    w = _order(key)
    full = F.col("pos") >= back + smooth
    return df.withColumn("now", F.when(full, F.avg("v").over(w.rowsBetween(-(smooth - 1), 0)))).withColumn("before", F.when(full, F.avg("v").over(w.rowsBetween(-(back + smooth - 1), -back))))


def delta_lookback(df: DataFrame, back: int, key: Sequence[str] = KEY) -> DataFrame:
    """Adds delta: the value minus that `back` samples earlier in the same segment."""
    return df.withColumn("delta", F.when(F.col("pos") > back, F.col("v") - F.lag("v", back).over(_order(key))))


def robust_sigma(df: DataFrame, before: int | None = None, key: Sequence[str] = KEY) -> DataFrame:
    """By key: samples, sigma = 1.4826 times the median absolute deviation from the median, or the
    population deviation where that is 0, over t < before. Medians are exact."""
    rows = df.where(F.col("t") < before) if before is not None else df
    med = rows.groupBy(*key).agg(F.percentile("v", 0.5).alias("med"), F.stddev_pop("v").alias("sd"), F.count("*").alias("samples"))
    spread = rows.join(med, list(key)).groupBy(*key).agg(F.percentile(F.abs(F.col("v") - F.col("med")), 0.5).alias("mad"))
    return med.join(spread, list(key)).select(*key, "samples", F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).otherwise(F.col("sd")).alias("sigma"))


def gaps(df: DataFrame, step: int, key: Sequence[str] = KEY) -> DataFrame:
    """Places where more than `step` passes: after, before and the missing slots."""
    prev = F.lag("t").over(_order(key))
    return df.select(*key, prev.alias("after"), F.col("t").alias("before")).where(F.col("before") - F.col("after") > step).withColumn("missing_slots", ((F.col("before") - F.col("after")) / step).cast("long") - 1)


def longest_streak(df: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """By key, over with_segments() rows: the longest contiguous streak, segments and samples."""
    return df.groupBy(*key).agg(F.max("pos").alias("longest"), F.max("seg").alias("segments"), F.count("*").alias("samples"))


def warm_up(df: DataFrame, start: int, key: Sequence[str] = KEY) -> DataFrame:
    """By key: samples before and from `start`, and how many of those before reach it without a gap."""
    first = F.min(F.when(F.col("t") >= start, F.struct("t", "pos")))
    return df.groupBy(*key).agg(F.count_if(F.col("t") < start).alias("history"), F.count_if(F.col("t") >= start).alias("target"), (first["pos"] - 1).alias("contiguous_prior"))


def scope(start: Column, end: Column, since: int) -> Column:
    """Where an interval lies against the start of an analysis."""
    return F.when(end < since, "warmup_only").when(start < since, "started_before_analysis").otherwise("started_in_analysis")


def clean_windows(df: DataFrame, alarms: DataFrame, length: int, stride: int, lo: float, hi: float, margin: int, bucket: int = 86_400) -> DataFrame:
    """Windows of `length` samples, every `stride` samples of a segment, that are wholly inside
    [lo, hi] and at least `margin` seconds from any alarm of alarms(entity, trigger_at,
    last_positive_at)."""
    frame = _order(KEY).rowsBetween(-(length - 1), 0)
    full = df.withColumn("inside", F.min(F.col("v").between(lo, hi).cast("int")).over(frame)).withColumn("start", F.min("t").over(frame))
    win = full.where((F.col("pos") >= length) & ((F.col("pos") - length) % stride == 0) & (F.col("inside") == 1)).select("entity", "start", F.col("t").alias("end"))
    from .links import by_bucket

    near = alarms.select("entity", (F.col("trigger_at") - margin).alias("a"), (F.col("last_positive_at") + margin).alias("b"))
    hit = by_bucket(win, "start", "end", bucket).join(by_bucket(near, "a", "b", bucket), ["entity", "_bucket"]).where("a < end AND b > start").select("entity", "start").distinct()
    return win.join(hit, ["entity", "start"], "left_anti")
