"""Proofs of alarms from raw samples: features recomputed in decimals over their whole window, first
confirmation, promotion of monitors, and what speaks against an alarm's evidence. A proof says that a
stated alarm follows from samples and rules; it says nothing of whether the anomaly is real."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import rules as R
from . import series as S
from .executor import EXECUTORS, _feature

_DEC = "decimal(28,9)"


def _values(n: int, back: int = 0) -> Column:
    """The n values that end `back` samples ago, as decimals, the oldest first."""
    w = W.partitionBy("entity").orderBy("t").rowsBetween(-(n + back - 1), -back)
    return F.collect_list(F.col("v").cast(_DEC)).over(w)


def _sum(values: Column, of=lambda x, i: x) -> Column:
    terms = F.transform(values, of)
    return F.aggregate(terms, F.lit(0).cast("decimal(38,12)"), lambda a, x: (a + x).cast("decimal(38,12)"))


def _times(middle: Column):
    """Each value times its place in the window, counted from the middle."""
    return lambda x, i: (x * (i.cast("decimal(10,0)") - middle)).cast("decimal(38,12)")


def _mean(values: Column, n: int) -> Column:
    return (_sum(values) / F.lit(n).cast("decimal(10,0)")).cast("decimal(28,12)")


def decimal_features(samples: DataFrame, lengths: dict[str, list[int]], smooth: int) -> DataFrame:
    """samples with slope_n, fitted_n, std_n, now_n and before_n for the lengths that rules ask for, from
    arrays of a window's values (as long as the window, no longer); null until the segment fills it."""
    x = samples
    for n in lengths.get("slope", []):
        full, middle = F.col("pos") >= n, F.lit(n - 1).cast("decimal(10,0)") / F.lit(2).cast("decimal(4,0)")
        squares = F.lit(sum((i - (n - 1) / 2) ** 2 for i in range(n))).cast("decimal(20,2)")
        x = x.withColumn("_w", _values(n)).withColumn("_m", _mean(F.col("_w"), n))
        slope = _sum(F.col("_w"), _times(middle)) / squares
        x = x.withColumn(f"slope_{n}", F.when(full, slope.cast("decimal(28,12)"))).withColumn(f"fitted_{n}", F.col("_m") + F.col(f"slope_{n}") * F.lit((n - 1) / 2).cast("decimal(10,1)")).drop("_w", "_m")
    for n in lengths.get("stuck_std", []):
        x = x.withColumn("_w", _values(n)).withColumn("_m", _mean(F.col("_w"), n))
        # the mean square as a decimal; its root alone is a double
        square = F.transform(F.arrays_zip(F.col("_w").alias("w"), F.array_repeat("_m", n).alias("m")), lambda p: ((p["w"] - p["m"]).cast("decimal(18,9)") * (p["w"] - p["m"]).cast("decimal(18,9)")).cast("decimal(38,12)"))
        x = x.withColumn(f"std_{n}", F.when(F.col("pos") >= n, F.sqrt((_sum(square) / n).cast("double")))).drop("_w", "_m")
    for n in lengths.get("window_change", []):
        full = F.col("pos") >= n + smooth
        x = x.withColumn(f"now_{n}", F.when(full, _mean(_values(smooth), smooth))).withColumn(f"before_{n}", F.when(full, _mean(_values(smooth, n), smooth)))
    return x


def window_proofs(samples: DataFrame, claims: DataFrame, rules: DataFrame, sigma: DataFrame, step: int, smooth: int = 2) -> DataFrame:
    """claims(alarm_id, entity, rule_id, at) with executor, state, reason and metric. consistent: the
    rule's condition holds at the sample `at`, its window is whole, and `at` is the first sample that
    confirms the run. samples are with_segments() rows. unassessed: a partial rule, or a slope without a
    positive sigma. Nothing of how the alarm was found is used."""
    lengths: dict[str, list[int]] = {}
    for r in rules.where("window IS NOT NULL").select("executor", "window").distinct().collect():  # of the rule table
        lengths.setdefault(r.executor, []).append(r.window)
    wanted = claims.select("entity", "rule_id").distinct()
    x = decimal_features(samples, lengths, smooth).join(rules.join(wanted, ["entity", "rule_id"], "left_semi"), "entity").join(sigma.select("entity", "sigma"), "entity", "left")
    v = F.col("v").cast(_DEC)
    limit, second, nominal = (F.col(c).cast(_DEC) for c in ("value", "second", "nominal"))
    one = lambda e, f: _feature(lengths, e, f)
    slope, now, before = one("slope", "slope"), one("window_change", "now"), one("window_change", "before")
    by = {
        "threshold_scan": (R.violates(F.col("op"), v, limit, second), v.cast("double")),
        "slope": ((F.abs(slope) > F.col("value") * F.col("sigma")) & ((one("slope", "fitted") - F.col("nominal")) * slope > 0), slope),
        "stuck_std": (one("stuck_std", "std") < F.col("value"), one("stuck_std", "std")),
        "outside_run": ((v < limit) | (v > second), v.cast("double")),
        "window_change": ((F.abs(now - before) > F.col("value")) & (F.abs(now - F.col("nominal")) > F.abs(before - F.col("nominal"))), F.abs(now - before)),
        "sustained_from_nominal": (F.abs(v - nominal) > limit, F.abs(v - nominal).cast("double")),
        "partial_threshold": (R.violates(F.col("op"), v, limit), v.cast("double")),
    }
    cond, metric = F.lit(None).cast("boolean"), F.lit(None).cast("double")
    for name in EXECUTORS:
        cond = F.when(F.col("executor") == name, by[name][0]).otherwise(cond)
        metric = F.when(F.col("executor") == name, by[name][1]).otherwise(metric)
    key = ("entity", "rule_id")
    runs = S.with_runs(x.withColumn("metric", metric), cond, key)
    nth = (F.col("t") - F.col("run_start")) / step + 1
    duration = F.coalesce("duration", F.lit(0))
    fits = F.col("cond") & ((duration == 0) | (F.col("t") - F.col("run_start") > duration))
    # how many samples of the run, up to this one, qualify
    upto = W.partitionBy(*key, "run_start").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    need = F.when(F.col("executor") == "threshold_scan", 1).otherwise(F.coalesce("readings", F.lit(1)))
    ready = F.col("window").isNull() | (F.col("pos") >= F.col("window") + F.when(F.col("executor") == "window_change", smooth).otherwise(0))
    rows = runs.withColumn("qualified", F.when(F.col("executor") == "threshold_scan", F.count_if(fits).over(upto)).otherwise(nth)).withColumn("need", need).withColumn("ready", ready)
    got = claims.join(rows.select(*key, F.col("t").alias("at"), "executor", "cond", "qualified", "need", "ready", "metric", "sigma"), [*key, "at"], "left")
    unassessed = F.when(F.col("executor") == "partial_threshold", "partial precondition").when((F.col("executor") == "slope") & ~F.coalesce(F.col("sigma") > 0, F.lit(False)), "positive verified sigma required")
    wrong = F.when(F.col("executor").isNull(), "no such sample or rule").when(~F.col("ready"), "incomplete contiguous feature window").when(~F.col("cond"), "feature condition not satisfied").when(F.col("qualified") != F.col("need"), "not the first confirmation")
    state = F.when(unassessed.isNotNull(), "unassessed").when(wrong.isNotNull(), "inconsistent").otherwise("consistent")
    return got.select("alarm_id", "executor", state.alias("state"), F.coalesce(unassessed, wrong, F.lit("")).alias("reason"), "metric")


def signal_hash(prefix: str, fields: list[Column]) -> Column:
    """An id made of content: a prefix and 20 digits of the hash of the fields as text."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]).cast("binary"), 256), 1, 20))


def promotion_issues(promoted: DataFrame, causes: DataFrame, pairs: DataFrame, nominal: DataFrame) -> DataFrame:
    """promoted(alarm_id, entity, source_signal, trigger_at, run_start, trigger_value, monitored_by,
    anchor, window_to) with issues: what keeps the promotion from following from its own record. A signal
    that was removed when it was promoted must come back, by hash, from the fields that the alarm kept.
    causes(cause_id, cause, first_warning), pairs(cause, effect, within, direction), nominal(entity, nominal)."""
    again = signal_hash("sig-", [F.col("entity"), F.col("trigger_at"), F.col("run_start"), F.col("trigger_value")])
    j = promoted.join(causes, F.col("monitored_by") == F.col("cause_id"), "left")
    j = j.join(pairs.withColumnsRenamed({"cause": "p_cause", "effect": "p_effect"}), (F.col("cause") == F.col("p_cause")) & (F.col("entity") == F.col("p_effect")), "left").join(nominal, "entity", "left")
    above = F.col("trigger_value") > F.col("nominal")
    side = F.when(F.col("direction") == "above_nominal", above).when(F.col("direction") == "below_nominal", F.col("trigger_value") < F.col("nominal"))
    checks = [
        ("signal_not_reconstructed", F.col("source_signal") != again),
        ("no_such_cause", F.col("cause").isNull()),
        ("no_warning", F.col("cause").isNotNull() & F.col("first_warning").isNull()),
        ("no_such_pair", F.col("cause").isNotNull() & F.col("direction").isNull()),
        ("wrong_anchor", F.col("anchor") != F.col("first_warning")),
        ("wrong_window", F.col("window_to") != F.col("anchor") + F.col("within")),
        ("outside_window", (F.col("trigger_at") < F.col("anchor")) | (F.col("trigger_at") > F.col("window_to"))),
        ("wrong_direction", ~side),
    ]
    return j.select("alarm_id", F.array_join(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in checks]), ",").alias("issues"))


def grounding_issues(claims: DataFrame, sealed: DataFrame, observations: DataFrame, rules: DataFrame, sources: DataFrame, units: DataFrame) -> DataFrame:
    """claims with issues: each alarm of a decision against what was sealed and observed.

    claims(alarm_id, incident_id, entity, rule_id, run_start, trigger_at, trigger_value, unit, source_id,
    source_sha256, value), sealed(the alarm's own fields, by alarm_id, with its incident), observations(
    entity, t, v, unit), rules(rule_id, entity, value), sources(source_id, sha256), units(entity, unit)."""
    own = sealed.select(F.col("alarm_id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in ("incident_id", "entity", "rule_id", "run_start", "trigger_at", "trigger_value")])
    seen = observations.groupBy(F.col("entity").alias("o_entity"), F.col("t").alias("o_t")).agg(F.count("*").alias("o_n"), F.min("v").alias("o_v"), F.min("unit").alias("o_unit"))
    bound = rules.groupBy(F.col("rule_id").alias("r_id"), F.col("entity").alias("r_entity")).agg(F.count("*").alias("r_n"), F.min("value").alias("r_value"))
    given = sources.groupBy(F.col("source_id").alias("s_id")).agg(F.count("*").alias("s_n"), F.min("sha256").alias("s_sha"))
    per = claims.groupBy(F.col("alarm_id").alias("c_id")).agg(F.count("*").alias("c_n"))
    # of the sealed incident, how many alarms it has and how many of them are claimed
    want = sealed.groupBy(F.col("incident_id").alias("i_id")).agg(F.count("*").alias("i_n"))
    have = claims.select("incident_id", "alarm_id").distinct().join(sealed.select("incident_id", "alarm_id"), ["incident_id", "alarm_id"], "left_semi").groupBy(F.col("incident_id").alias("h_id")).agg(F.count("*").alias("h_n"))
    j = (
        claims.join(own, F.col("alarm_id") == F.col("_id"), "left")
        .join(seen, (F.col("entity") == F.col("o_entity")) & (F.col("trigger_at") == F.col("o_t")), "left")
        .join(bound, (F.col("rule_id") == F.col("r_id")) & (F.col("entity") == F.col("r_entity")), "left")
        .join(given, F.col("source_id") == F.col("s_id"), "left")
        .join(units.select(F.col("entity").alias("u_entity"), F.col("unit").alias("u_unit")), F.col("entity") == F.col("u_entity"), "left")
        .join(per, F.col("alarm_id") == F.col("c_id"))
        .join(want, F.col("incident_id") == F.col("i_id"), "left")
        .join(have, F.col("incident_id") == F.col("h_id"), "left")
    )
    known = F.col("_id").isNotNull()
    checks = [
        ("alarm_not_sealed", ~known),
        ("alarm_claimed_twice", F.col("c_n") > 1),
        ("alarm_not_in_incident", known & (F.col("incident_id") != F.col("_incident_id"))),
        ("incident_unknown", F.col("i_n").isNull()),
        ("alarm_set_differs", F.col("i_n").isNotNull() & (F.coalesce("h_n", F.lit(0)) != F.col("i_n"))),
        ("entity_differs", known & (F.col("entity") != F.col("_entity"))),
        ("rule_differs", known & (F.col("rule_id") != F.col("_rule_id"))),
        ("start_differs", known & (F.col("run_start") != F.col("_run_start"))),
        ("trigger_differs", known & (F.col("trigger_at") != F.col("_trigger_at"))),
        ("value_differs", known & (F.col("trigger_value") != F.col("_trigger_value"))),
        ("no_observation", F.col("o_n").isNull()),
        ("observed_twice", F.col("o_n") > 1),
        ("observation_differs", F.col("o_v") != F.col("trigger_value")),
        ("units_disagree", (F.col("o_unit") != F.col("unit")) | (F.col("u_unit") != F.col("unit"))),
        ("rule_not_bound_once", F.coalesce("r_n", F.lit(0)) != 1),
        ("parameters_differ", F.col("r_value") != F.col("value")),
        ("source_missing", F.col("s_n").isNull()),
        ("source_repeated", F.col("s_n") > 1),
        ("source_altered", F.col("s_sha") != F.col("source_sha256")),
    ]
    return j.select("alarm_id", F.array_join(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in checks]), ",").alias("issues"))
