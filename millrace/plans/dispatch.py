"""Rules of all seven executors over one series, the incidents and types that come of them, and links
that need the cause to have opened the effect's monitor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import executor, links, series
from .detection import ANCHORS_SQL, CUT, GAP, H, PAIRS_SQL, SESSIONS_SQL, _SIGMA, _SIGNALS, _STD, alarms, anchors, grid_sql, hourly, limits, pairs, run_sql, seg_sql, signals
from .registry import Tables, query

_THRESHOLDS = [("T-click", "kg_threshold_warning", "click", "gt", 110.0, None, 0), ("T-error", "kg_threshold_critical", "error", "gt", 170.0, None, 0), ("T-signup", "kg_document_rule", "signup", "outside", 40.0, 120.0, H)]
_TYPES = [("S-view", "sop002_drift_slope", "view", "slope", 0.2, None, 6, 2, 70.0), ("S-error", "sop002_stuck_std", "error", "stuck_std", 25.0, None, 4, 1, None), ("S-click", "sop002_stuck_std", "click", "stuck_std", 25.0, None, 4, 1, None), ("S-purchase", "sop002_out_of_range", "purchase", "outside_run", 36.0, 100.0, None, 3, None), ("S-error-o", "sop002_out_of_range", "error", "outside_run", 40.0, 105.0, None, 2, None)]
_MAINTENANCE = [("M-click", "kg_maint_drift", "click", "window_change", 40.0, 4, None, 75.0), ("M-signup", "kg_maint_drift", "signup", "sustained_from_nominal", 20.0, None, 4, 75.0)]
_PARTIAL = [("P-error", "kg_document_rule_partial", "error", "lt", 30.0, "precondition_unobserved")]


def rule_table(tb: Tables) -> DataFrame:
    """Threshold, type, maintenance and partial rules, each with the columns that it has."""
    t = tb.rows(_THRESHOLDS, "rule_id string, kind string, entity string, op string, value double, second double, duration long").withColumn("executor", F.lit("threshold_scan"))
    y = tb.rows(_TYPES, "rule_id string, kind string, entity string, executor string, value double, second double, window int, readings int, nominal double")
    m = tb.rows(_MAINTENANCE, "rule_id string, kind string, entity string, executor string, value double, window int, readings int, nominal double")
    p = tb.rows(_PARTIAL, "rule_id string, kind string, entity string, op string, value double, flag string").withColumn("executor", F.lit("partial_threshold"))
    return executor.normalise(t, y, m, p)


_FIELDS = ("rule_id", "kind", "entity", "executor", "op", "value", "second", "duration", "window", "readings", "nominal", "flag")


def _literal(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


_NORMAL = (
    [(r, k, e, "threshold_scan", o, v, s, d, None, None, None, None) for r, k, e, o, v, s, d in _THRESHOLDS]
    + [(r, k, e, x, None, v, s, None, w, n, m, None) for r, k, e, x, v, s, w, n, m in _TYPES]
    + [(r, k, e, x, None, v, None, None, w, n, m, None) for r, k, e, x, v, w, n, m in _MAINTENANCE]
    + [(r, k, e, "partial_threshold", o, v, None, None, None, None, None, f) for r, k, e, o, v, f in _PARTIAL]
)
_NORMAL_SQL = f"ir({', '.join(f if f != 'window' else chr(34) + f + chr(34) for f in _FIELDS)}) AS (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in _NORMAL)})"


@query(f"WITH {_NORMAL_SQL} SELECT * REPLACE (value::DOUBLE AS value, second::DOUBLE AS second, nominal::DOUBLE AS nominal, duration::BIGINT AS duration) FROM ir")
def normalised_rules(tb):
    return rule_table(tb)


def _alarm_sql(i: int, rule: tuple) -> str:
    """One rule's alarms, from its own condition written out."""
    r = dict(zip(_FIELDS, rule, strict=True))
    v, s, n = r["value"], r["second"], r["nominal"]
    by = {"gt": f"v > {v}", "lt": f"v < {v}", "outside": f"v < {v} OR v > {s}"}
    cond = {
        "threshold_scan": by.get(r["op"]), "partial_threshold": by.get(r["op"]), "outside_run": by["outside"], "stuck_std": f"sd < {v}",
        "slope": f"abs(sl) > {v} * sigma AND sign(m + sl * 2.5 - {n}) = sign(sl)", "window_change": f"abs(nw - bf) > {v} AND abs(nw - {n}) > abs(bf - {n})", "sustained_from_nominal": f"abs(v - {n}) > {v}",
    }[r["executor"]]
    hit = (f"t - start > {r['duration']}" if r["duration"] else "TRUE") if r["executor"] == "threshold_scan" else f"rn >= {r['readings'] or 1}"
    back = (r["window"] - 1) * H if r["executor"] == "stuck_std" else 0
    return f"x{i} AS (SELECT * FROM feats WHERE entity = '{r['entity']}'), {run_sql(cond, f'x{i}', f'y{i}_')}, z{i} AS (SELECT entity, '{r['rule_id']}' AS rule_id, start AS run_start, '{r['kind']}' AS kind, {_literal(r['flag'])}::VARCHAR AS flag, start - {back} AS condition_start, min(t) AS trigger_at, max(t) AS last_positive_at, count(*) AS positive_samples, arg_min(v, t) AS trigger_value FROM y{i}_ WHERE {hit} GROUP BY entity, start)"


_FEATS = (
    f"feats AS (SELECT s.*, {_STD} AS sd, CASE WHEN pos >= 6 THEN regr_slope(v, pos::DOUBLE) OVER w6 END AS sl, CASE WHEN pos >= 6 THEN avg(v) OVER w6 END AS m,"
    " CASE WHEN pos >= 6 THEN avg(v) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) END AS nw, CASE WHEN pos >= 6 THEN avg(v) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN 5 PRECEDING AND 4 PRECEDING) END AS bf,"
    " sigma FROM s LEFT JOIN sigma USING (entity) WINDOW w6 AS (PARTITION BY entity ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))"
)
_EXECUTED = f"{grid_sql(H)}, {_SIGMA.format(CUT)}, {seg_sql(H)}, {_FEATS}, {', '.join(_alarm_sql(i, r) for i, r in enumerate(_NORMAL))}, al AS (SELECT *, rule_id || '-' || entity || '-' || trigger_at AS alarm_id FROM ({' UNION ALL '.join(f'SELECT * FROM z{i}' for i in range(len(_NORMAL)))}))"
_EXECUTED_SESSIONS = f"{_EXECUTED}, se0 AS (SELECT *, CASE WHEN trigger_at <= max(last_positive_at) OVER (PARTITION BY entity ORDER BY trigger_at, alarm_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {GAP} THEN 0 ELSE 1 END AS nw FROM al), se AS (SELECT *, sum(nw) OVER (PARTITION BY entity ORDER BY trigger_at, alarm_id)::BIGINT AS session FROM se0)"
_VALUE_KINDS = "kind IN ('kg_document_rule', 'kg_document_rule_partial', 'kg_threshold_warning', 'kg_threshold_critical', 'sop002_out_of_range')"
_DRIFT = "kind IN ('sop002_drift_slope', 'kg_maint_drift')"
_TYPES_SQL = f"CASE WHEN bool_or(kind = 'sop002_stuck_std') THEN 'STUCK' WHEN bool_or(kind = 'kg_threshold_critical') AND max(last_positive_at) FILTER ({_VALUE_KINDS}) - min(trigger_at) FILTER ({_VALUE_KINDS}) < 7200 THEN 'SPIKE' WHEN bool_or({_DRIFT}) AND (NOT bool_or({_VALUE_KINDS}) OR min(trigger_at) FILTER ({_DRIFT}) < min(trigger_at) FILTER ({_VALUE_KINDS}) OR NOT bool_or(kind = 'sop002_out_of_range')) THEN 'DRIFT' WHEN bool_or(kind = 'sop002_out_of_range') THEN 'OUT_OF_RANGE' ELSE 'UNCLASSIFIED' END"


def executed(tb: Tables) -> DataFrame:
    g = series.grid(tb.events, H)
    return executor.execute(hourly(tb), rule_table(tb), series.robust_sigma(g, CUT), H)


@query(f"WITH {_EXECUTED} SELECT alarm_id, entity, rule_id, kind, flag, run_start, condition_start, trigger_at, last_positive_at, positive_samples, trigger_value FROM al")
def executed_alarms(tb):
    return executed(tb).select("alarm_id", "entity", "rule_id", "kind", "flag", "run_start", "condition_start", "trigger_at", "last_positive_at", "positive_samples", "trigger_value")


@query(f"WITH {_EXECUTED_SESSIONS} SELECT entity, session, count(*) AS alarms, {_TYPES_SQL} AS anomaly_type FROM se GROUP BY entity, session")
def executed_types(tb):
    """Incidents of all executors by type: stuck ones and drifts by slope included."""
    s = links.sessions(executed(tb), GAP, tie=("alarm_id",))
    n = s.groupBy("entity", "session").agg(F.count("*").alias("alarms"))
    return links.classify(s, spike_seconds=7200).join(n, ["entity", "session"]).select("entity", F.col("session").cast("long").alias("session"), "alarms", "anomaly_type")


_PROMOTED = (
    f"prom0 AS (SELECT signal_id, sg.entity, sg.trigger_at, sg.last_positive_at, trigger_value, cause_id AS monitored_by, anchor FROM sg JOIN pairs ON effect = sg.entity JOIN anc USING (cause) JOIN lim ON lim.entity = effect WHERE trigger_at BETWEEN anchor AND anchor + \"within\" AND CASE direction WHEN 'above_nominal' THEN trigger_value > nominal ELSE trigger_value < nominal END),"
    " prom AS (SELECT * FROM prom0 QUALIFY row_number() OVER (PARTITION BY signal_id ORDER BY anchor DESC, monitored_by DESC) = 1),"
    " am AS (SELECT alarm_id, entity, trigger_at, last_positive_at, trigger_value, NULL AS monitored_by FROM al UNION ALL SELECT signal_id, entity, trigger_at, last_positive_at, trigger_value, monitored_by FROM prom),"
    f" sm0 AS (SELECT *, CASE WHEN trigger_at <= max(last_positive_at) OVER (PARTITION BY entity ORDER BY trigger_at, alarm_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {GAP} THEN 0 ELSE 1 END AS nw FROM am), sm AS (SELECT *, sum(nw) OVER (PARTITION BY entity ORDER BY trigger_at, alarm_id)::BIGINT AS session FROM sm0),"
    " eff AS (SELECT entity || '@' || session AS effect_id, entity AS effect, min(trigger_at) AS start, max(trigger_value) AS high, min(trigger_value) AS low, coalesce(list(DISTINCT monitored_by) FILTER (monitored_by IS NOT NULL), []) AS monitors FROM sm GROUP BY entity, session)"
)


@query(
    f"WITH {SESSIONS_SQL}, {ANCHORS_SQL}, {_SIGNALS}, {PAIRS_SQL}, {_PROMOTED},"
    " x AS (SELECT effect_id, effect, start, cause_id, cause, anchor, len(monitors) > 0 AS monitored FROM eff JOIN pairs USING (effect) JOIN anc USING (cause) JOIN lim ON lim.entity = effect WHERE anchor BETWEEN start - \"within\" AND start AND CASE direction WHEN 'above_nominal' THEN high > nominal ELSE low < nominal END AND (len(monitors) = 0 OR list_contains(monitors, cause_id)))"
    " SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY effect_id ORDER BY anchor DESC, cause_id DESC) = 1"
)
def monitored_links(tb):
    """verified_links over incidents that hold promoted monitor alarms: an effect with monitors is linked
    to a cause that opened one of them alone."""
    lim = limits(tb).select("entity", "nominal")
    sig = signals(tb)
    said = links.promote(sig.join(lim, "entity"), anchors(tb), pairs(tb), F.col("nominal")).select("signal_id", "monitored_by")
    monitors = sig.join(said, "signal_id").select(F.col("signal_id").alias("alarm_id"), "entity", "trigger_at", "last_positive_at", "trigger_value", "monitored_by")
    every = alarms(tb).select("alarm_id", "entity", "trigger_at", "last_positive_at", "trigger_value", F.lit(None).cast("string").alias("monitored_by")).unionByName(monitors)
    s = links.sessions(every, GAP, tie=("alarm_id",))
    eff = s.groupBy("entity", "session").agg(F.min("trigger_at").alias("start"), F.max("trigger_value").alias("high"), F.min("trigger_value").alias("low"), F.collect_set("monitored_by").alias("monitors")).join(lim, "entity")
    eff = eff.select(F.concat_ws("@", "entity", F.col("session").cast("string")).alias("effect_id"), F.col("entity").alias("effect"), "start", "high", "low", "nominal", "monitors")
    out = links.verified_links(eff, anchors(tb), pairs(tb), F.col("nominal"))
    return out.join(eff.select("effect_id", (F.size("monitors") > 0).alias("monitored")), "effect_id").select("effect_id", "effect", "start", "cause_id", "cause", "anchor", "monitored")
