"""Proofs of executed alarms and promoted monitors, and the grounding of decisions, each over records of
which some have been altered."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import links, proofs, series
from . import detection as D
from . import dispatch as X
from .detection import CUT, H
from .registry import query

_ALTERED = f"(trigger_at // {H}) % 5 = 0 AND last_positive_at <> trigger_at"
_METRIC = (
    "CASE executor WHEN 'slope' THEN sl WHEN 'stuck_std' THEN sd WHEN 'window_change' THEN abs(nw - bf) WHEN 'sustained_from_nominal' THEN abs(v - nominal) ELSE v END"
)


@query(
    f"WITH {X._EXECUTED}, {X._NORMAL_SQL}, cl AS (SELECT al.*, CASE WHEN {_ALTERED} THEN last_positive_at ELSE trigger_at END AS at, {_ALTERED} AS altered FROM al)"
    f" SELECT alarm_id, executor, CASE WHEN executor = 'partial_threshold' THEN 'unassessed' WHEN altered THEN 'inconsistent' ELSE 'consistent' END AS state, CASE WHEN executor = 'partial_threshold' THEN 'partial precondition' WHEN altered THEN 'not the first confirmation' ELSE '' END AS reason, round(({_METRIC})::DOUBLE, 4) AS metric"
    " FROM cl JOIN ir ON ir.rule_id = cl.rule_id JOIN feats ON feats.entity = cl.entity AND feats.t = cl.at"
)
def window_proofs(tb):
    """Every executed alarm proven from its samples in decimals; a part of them claims a later sample of
    the run than the one that confirmed it."""
    a = X.executed(tb)
    altered = (F.floor(F.col("trigger_at") / H) % 5 == 0) & (F.col("last_positive_at") != F.col("trigger_at"))
    claims = a.select("alarm_id", "entity", "rule_id", F.when(altered, F.col("last_positive_at")).otherwise(F.col("trigger_at")).alias("at"))
    sigma = series.robust_sigma(series.grid(tb.events, H), CUT)
    return proofs.window_proofs(D.hourly(tb), claims, X.rule_table(tb), sigma, H).withColumn("metric", F.round(F.col("metric").cast("double"), 4))


_TAMPER = f"(trigger_at // {H}) % 7"


@query(
    f"WITH {D.SESSIONS_SQL}, {D.ANCHORS_SQL}, {D._SIGNALS}, {D.PAIRS_SQL}, x AS (SELECT signal_id, effect, trigger_at, cause_id, anchor, \"within\" FROM sg JOIN pairs ON effect = sg.entity JOIN anc USING (cause) JOIN lim ON lim.entity = effect WHERE trigger_at BETWEEN anchor AND anchor + \"within\" AND CASE direction WHEN 'above_nominal' THEN trigger_value > nominal ELSE trigger_value < nominal END),"
    " p AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY signal_id ORDER BY anchor DESC, cause_id DESC) = 1)"
    f" SELECT signal_id AS alarm_id, CASE {_TAMPER} WHEN 0 THEN 'signal_not_reconstructed' WHEN 1 THEN 'no_such_cause' WHEN 2 THEN 'wrong_anchor,wrong_window' WHEN 3 THEN 'wrong_window' ELSE '' END AS issues FROM p"
)
def monitor_proofs(tb):
    """Promoted monitors against their own record: the removed signal's hash, the cause's first warning,
    the window and the direction; some records have been altered."""
    lim = D.limits(tb).select("entity", "nominal")
    sig, anchors, pairs = D.signals(tb), D.anchors(tb), D.pairs(tb)
    said = links.promote(sig.join(lim, "entity"), anchors, pairs, F.col("nominal")).select("signal_id", "monitored_by", F.col("window_start").alias("anchor"))
    j = sig.join(said, "signal_id").join(anchors.select(F.col("cause_id").alias("monitored_by"), "cause"), "monitored_by").join(pairs.select("cause", F.col("effect").alias("entity"), "within"), ["cause", "entity"])
    k = F.floor(F.col("trigger_at") / H) % 7
    signal = proofs.signal_hash("sig-", [F.col("entity"), F.col("trigger_at"), F.col("run_start"), F.col("trigger_value")])
    kept = j.select(
        F.col("signal_id").alias("alarm_id"), "entity", F.when(k == 0, F.lit("sig-0")).otherwise(signal).alias("source_signal"), "trigger_at", "run_start", "trigger_value",
        F.when(k == 1, F.lit("none#0")).otherwise(F.col("monitored_by")).alias("monitored_by"), F.when(k == 2, F.col("anchor") - 60).otherwise(F.col("anchor")).alias("anchor"), (F.col("anchor") + F.col("within") + F.when(k == 3, 60).otherwise(0)).alias("window_to"),
    )
    causes = anchors.select("cause_id", "cause", F.col("anchor").alias("first_warning"))
    return proofs.promotion_issues(kept, causes, pairs, lim)


_G = f"(trigger_at // {H}) % 12"


@query(
    f"WITH {D.SESSIONS_SQL} SELECT alarm_id, CASE {_G} WHEN 1 THEN 'value_differs,observation_differs' WHEN 2 THEN 'start_differs' WHEN 3 THEN 'units_disagree' WHEN 4 THEN 'parameters_differ' WHEN 5 THEN 'source_missing' WHEN 6 THEN 'source_altered' WHEN 7 THEN 'rule_differs,rule_not_bound_once' WHEN 8 THEN 'source_repeated' ELSE '' END AS issues FROM se"
)
def decision_grounding(tb):
    """All alarms of decisions against sealed alarms, samples, rules and sources, some of them altered."""
    s = D.sessioned(tb).withColumn("incident_id", F.concat_ws("#", "entity", F.col("session").cast("string")))
    k = F.floor(F.col("trigger_at") / H) % 12
    sealed = s.select("alarm_id", "incident_id", "entity", "rule_id", "run_start", "trigger_at", "trigger_value")
    rules = D.alarm_rules(tb).select("rule_id", "entity", "value")
    source = F.concat_ws("/", "entity", "rule_id")
    claims = s.join(rules, ["rule_id", "entity"]).select(
        "alarm_id", "incident_id", "entity", F.when(k == 7, F.lit("NONE")).otherwise(F.col("rule_id")).alias("rule_id"), (F.col("run_start") - F.when(k == 2, H).otherwise(0)).alias("run_start"), "trigger_at",
        (F.col("trigger_value") + F.when(k == 1, 1.0).otherwise(0.0)).alias("trigger_value"), F.when(k == 3, F.lit("mA")).otherwise(F.lit("A")).alias("unit"),
        F.when(k == 5, F.lit("gone")).when(k == 8, F.lit("twice")).otherwise(source).alias("source_id"), F.when(k == 6, F.lit("0")).when(k == 8, F.sha2(F.lit(b"twice"), 256)).otherwise(F.sha2(source.cast("binary"), 256)).alias("source_sha256"), (F.col("value") + F.when(k == 4, 1.0).otherwise(0.0)).alias("value"),
    )
    sources = rules.select(source.alias("source_id"), F.sha2(source.cast("binary"), 256).alias("sha256")).unionByName(tb.rows([("twice",), ("twice",)], "source_id string").withColumn("sha256", F.sha2(F.lit(b"twice"), 256)))
    observed = series.grid(tb.events, H).select("entity", "t", "v").withColumn("unit", F.lit("A"))
    units = D.limits(tb).select("entity").withColumn("unit", F.lit("A"))
    return proofs.grounding_issues(claims, sealed, observed, rules, sources, units)
