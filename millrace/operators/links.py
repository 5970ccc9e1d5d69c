"""Joins of intervals and of events in time, and grouping of alarms into incidents.

Range conditions get an equi-join key: the bucket of time that an interval touches. Wide intervals
touch several buckets; pairs found in more than one are taken once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def by_bucket(df: DataFrame, start: str, end: str, bucket: int) -> DataFrame:
    """A row for each bucket of `bucket` seconds that [start, end] touches."""
    return df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.greatest(F.col(start), F.col(end)) / bucket))))


def overlap_join(left: DataFrame, right: DataFrame, ls: str, le: str, rs: str, re: str, on: str = "entity", bucket: int = 86_400, how: str = "inner") -> DataFrame:
    """Pairs of the same `on` with left [ls, le] and right [rs, re] overlapping, ends included. The
    pair is made in the bucket where the later of the two begins, so once. how: inner or left_semi."""
    a = by_bucket(left, ls, le, bucket)
    b = by_bucket(right, rs, re, bucket).withColumnsRenamed({on: "_on", "_bucket": "_other"})
    cond = (F.col(on) == F.col("_on")) & (F.col("_bucket") == F.col("_other")) & (F.col(ls) <= F.col(re)) & (F.col(le) >= F.col(rs))
    if how == "left_semi":
        return a.join(b, cond, "left_semi").drop("_bucket").distinct()
    cond &= F.col("_bucket") == F.floor(F.greatest(F.col(ls), F.col(rs)) / bucket)
    return a.join(b, cond).drop("_on", "_other", "_bucket")


def as_of(effects: DataFrame, causes: DataFrame, pairs: DataFrame, within: str = "within", bucket: int = 86_400) -> DataFrame:
    """Each effect with its latest cause in [start - within, start]; ties go to the larger cause id.
    effects(effect_id, effect, start), causes(cause_id, cause, cause_start), pairs(cause, effect, within)."""
    want = effects.join(pairs, "effect").withColumn("_from", F.col("start") - F.col(within))
    want = by_bucket(want, "_from", "start", bucket)
    have = causes.withColumn("_bucket", F.floor(F.col("cause_start") / bucket))
    hits = want.join(have, ["cause", "_bucket"]).where((F.col("cause_start") >= F.col("_from")) & (F.col("cause_start") <= F.col("start")))
    best = hits.groupBy("effect_id").agg(F.max(F.struct("cause_start", "cause_id", "cause")).alias("m"), F.first("effect").alias("effect"), F.first("start").alias("start"))
    return best.select("effect_id", "effect", "start", "m.cause_id", "m.cause", "m.cause_start", (F.col("start") - F.col("m.cause_start")).alias("lag"))


def sessions(alarms: DataFrame, gap: int, start: str = "trigger_at", end: str = "last_positive_at", key: tuple[str, ...] = ("entity",), tie: tuple[str, ...] = ()) -> DataFrame:
    """Adds session, numbered by key: an alarm joins the session before it if it starts at most
    `gap` seconds after the latest end so far."""
    w = W.partitionBy(*key).orderBy(start, *tie)
    latest = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    out = alarms.withColumn("_new", F.when(F.col(start) <= latest + gap, 0).otherwise(1))
    return out.withColumn("session", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


SEVERITIES = ("ADVISORY", "WARNING", "CRITICAL")
#: Fixed kinds of alarms that compare values with limits, and that see drift.
VALUE_KINDS = ("kg_document_rule", "kg_document_rule_partial", "kg_threshold_warning", "kg_threshold_critical", "sop002_out_of_range")
DRIFT_KINDS = ("sop002_drift_slope", "kg_maint_drift")


def severity_rank(kind: Column) -> Column:
    return F.when(kind == "kg_threshold_critical", 2).when(kind.isin("kg_threshold_warning", "sop002_out_of_range"), 1).otherwise(0)


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), (rank + 1).cast("int"))


def incidents(sessioned: DataFrame, key: tuple[str, ...] = ("entity",), tag: str | None = None) -> DataFrame:
    """Incidents of sessioned alarms(…, kind, rule_id, alarm_id, trigger_at, last_positive_at,
    run_start). A tag column with a severity name raises the incident's severity, never lowers it."""
    rank = severity_rank(F.col("kind"))
    if tag:
        rank = F.greatest(rank, F.when(F.col(tag) == "CRITICAL", 2).when(F.col(tag) == "WARNING", 1).otherwise(0))
    return sessioned.groupBy(*key, "session").agg(
        F.min("trigger_at").alias("start"),
        F.max("last_positive_at").alias("end"),
        F.min("run_start").alias("onset_estimate"),
        F.count("*").alias("alarms"),
        F.array_sort(F.collect_set("kind")).alias("kinds"),
        F.array_sort(F.collect_set("rule_id")).alias("rule_ids"),
        F.array_sort(F.collect_set("alarm_id")).alias("alarm_ids"),
        severity_name(F.max(rank)).alias("severity"),
    )


def classify(sessioned: DataFrame, key: tuple[str, ...] = ("entity",), spike_seconds: int = 300, stuck_rules: tuple[str, ...] = ("RULE-ST03-03", "MAINT-03")) -> DataFrame:
    """anomaly_type of each session by fixed priority: STUCK, SPIKE (a critical alarm and threshold
    alarms spanning less than spike_seconds), DRIFT (a drift alarm, and no value alarm, or drift
    strictly earlier, or no out-of-range alarm), OUT_OF_RANGE, UNCLASSIFIED."""
    kind = F.col("kind")
    stuck = (kind == "sop002_stuck_std") | F.coalesce(F.col("rule_id").rlike("^(" + "|".join(stuck_rules) + ")"), F.lit(False))
    value = kind.isin(*VALUE_KINDS)
    drift = kind.isin(*DRIFT_KINDS)
    g = sessioned.groupBy(*key, "session").agg(
        F.max(stuck).alias("stuck"),
        F.max(kind == "kg_threshold_critical").alias("critical"),
        F.max(F.when(value, F.col("last_positive_at"))).alias("v_end"),
        F.min(F.when(value, F.col("trigger_at"))).alias("v_start"),
        F.min(F.when(drift, F.col("trigger_at"))).alias("d_start"),
        F.max(kind == "sop002_out_of_range").alias("oor"),
    )
    name = (
        F.when(F.col("stuck"), "STUCK")
        .when(F.col("critical") & (F.col("v_end") - F.col("v_start") < spike_seconds), "SPIKE")
        .when(F.col("d_start").isNotNull() & (F.col("v_start").isNull() | (F.col("d_start") < F.col("v_start")) | ~F.col("oor")), "DRIFT")
        .when(F.col("oor"), "OUT_OF_RANGE")
        .otherwise("UNCLASSIFIED")
    )
    return g.select(*key, "session", name.alias("anomaly_type"))


def attach_signals(signals: DataFrame, incidents: DataFrame, gap: int, bucket: int = 86_400) -> DataFrame:
    """Pairs (entity, session, signal_id): a signal that starts by the incident's end and lasts until
    `gap` seconds before its start. Signals add to an incident; they never make or bound one."""
    inc = incidents.select("entity", "session", (F.col("start") - gap).alias("_s"), F.col("end").alias("_e"))
    return overlap_join(inc, signals.select("entity", "signal_id", F.col("trigger_at").alias("_a"), F.col("last_positive_at").alias("_b")), "_s", "_e", "_a", "_b", bucket=bucket).select("entity", "session", "signal_id")


def promote(signals: DataFrame, causes: DataFrame, pairs: DataFrame, nominal: Column, bucket: int = 86_400) -> DataFrame:
    """Signals inside [anchor, anchor + within] of a cause that warned become alarms, if their value
    lies on the pair's side of the nominal value; one alarm a signal, the later window wins.
    signals(signal_id, entity, trigger_at, trigger_value), causes(cause_id, cause, anchor),
    pairs(cause, effect, within, direction)."""
    win = causes.join(pairs, "cause").withColumn("_to", F.col("anchor") + F.col("within"))
    win = by_bucket(win, "anchor", "_to", bucket)
    sig = signals.withColumn("_bucket", F.floor(F.col("trigger_at") / bucket)).withColumnRenamed("entity", "effect")
    hit = sig.join(win, ["effect", "_bucket"]).where((F.col("trigger_at") >= F.col("anchor")) & (F.col("trigger_at") <= F.col("_to")))
    side = F.when(F.col("direction") == "above_nominal", F.col("trigger_value") > nominal).when(F.col("direction") == "below_nominal", F.col("trigger_value") < nominal).otherwise(True)
    return hit.where(side).groupBy("signal_id").agg(F.max(F.struct("anchor", "cause_id")).alias("m"), F.first("effect").alias("effect"), F.first("trigger_at").alias("trigger_at")).select("signal_id", "effect", "trigger_at", F.col("m.cause_id").alias("monitored_by"), F.col("m.anchor").alias("window_start"))


def verified_links(effects: DataFrame, causes: DataFrame, pairs: DataFrame, nominal: Column, bucket: int = 86_400) -> DataFrame:
    """Each effect incident with the cause of the latest anchor in [start - within, start], if some
    alarm of the effect lies on the pair's side of nominal and, where the effect has monitor alarms,
    the cause opened one of them. effects(effect_id, effect, start, low, high, monitors array)."""
    want = effects.join(pairs, "effect").withColumn("_from", F.col("start") - F.col("within"))
    side = F.when(F.col("direction") == "above_nominal", F.col("high") > nominal).when(F.col("direction") == "below_nominal", F.col("low") < nominal).otherwise(True)
    want = by_bucket(want.where(side), "_from", "start", bucket)
    have = causes.withColumn("_bucket", F.floor(F.col("anchor") / bucket))
    hit = want.join(have, ["cause", "_bucket"]).where((F.col("anchor") >= F.col("_from")) & (F.col("anchor") <= F.col("start")))
    hit = hit.where((F.size("monitors") == 0) | F.array_contains("monitors", F.col("cause_id")))
    best = hit.groupBy("effect_id").agg(F.max(F.struct("anchor", "cause_id", "cause")).alias("m"), F.first("effect").alias("effect"), F.first("start").alias("start"))
    return best.select("effect_id", "effect", "start", "m.cause_id", "m.cause", "m.anchor")
