"""Series and incident queries, on buckets of the events table by type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import evaluate, executor, links, rules, series
from .registry import Tables, query

H = 3600
DAY = 86_400
#: Limits by event type: nominal, warning and critical upper limits, lower limit.
LIMITS = [("click", 75.0, 110.0, 180.0, 20.0), ("error", 75.0, 105.0, 190.0, 20.0), ("purchase", 70.0, 100.0, 180.0, 18.0), ("signup", 75.0, 115.0, 200.0, 22.0), ("view", 70.0, 105.0, 170.0, 19.0)]
LIMITS_SQL = "lim(entity, nominal, warn, crit, lo) AS (VALUES " + ", ".join(f"('{e}', {n}, {w}, {c}, {lo})" for e, n, w, c, lo in LIMITS) + ")"
PAIRS = [("error", "signup", 12 * H, "above_nominal"), ("view", "click", 12 * H, "below_nominal"), ("click", "purchase", 24 * H, "above_nominal")]
PAIRS_SQL = "pairs(cause, effect, \"within\", direction) AS (VALUES " + ", ".join(f"('{c}', '{e}', {w}, '{d}')" for c, e, w, d in PAIRS) + ")"


def grid_sql(step: int, name: str = "g") -> str:
    return f"{name} AS (SELECT event_type AS entity, (epoch_us(ts) // 1000000) // {step} * {step} AS t, max(value) AS v, count(*) AS n FROM events GROUP BY 1, 2)"


def seg_sql(step: int, src: str = "g", name: str = "s") -> str:
    return f"""{name}0 AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY entity ORDER BY t) = {step} THEN 0 ELSE 1 END AS isgap FROM {src}),
{name}1 AS (SELECT *, sum(isgap) OVER (PARTITION BY entity ORDER BY t) AS seg FROM {name}0),
{name} AS (SELECT *, row_number() OVER (PARTITION BY entity, seg ORDER BY t) AS pos FROM {name}1)"""


def run_sql(cond: str, src: str = "s", name: str = "r") -> str:
    """Islands of a condition: rid numbers them, rn counts samples, start is the first time."""
    return f"""{name}0 AS (SELECT *, coalesce(({cond}), FALSE) AS cond FROM {src}),
{name}1 AS (SELECT *, CASE WHEN NOT cond OR isgap = 1 OR NOT lag(cond) OVER (PARTITION BY entity ORDER BY t) THEN 1 ELSE 0 END AS newrun FROM {name}0),
{name}2 AS (SELECT *, sum(newrun) OVER (PARTITION BY entity ORDER BY t) AS rid FROM {name}1),
{name} AS (SELECT *, min(t) OVER (PARTITION BY entity, rid) AS start, row_number() OVER (PARTITION BY entity, rid ORDER BY t) AS rn FROM {name}2 WHERE cond)"""


def limits(tb: Tables) -> DataFrame:
    return tb.rows(LIMITS, "entity string, nominal double, warn double, crit double, lo double")


def pairs(tb: Tables) -> DataFrame:
    return tb.rows(PAIRS, "cause string, effect string, within long, direction string")


def hourly(tb: Tables) -> DataFrame:
    return series.with_segments(series.grid(tb.events, H), H)


def limited(tb: Tables) -> DataFrame:
    return hourly(tb).join(F.broadcast(limits(tb)), "entity")


@query(f"WITH {grid_sql(H)}, {seg_sql(H)} SELECT entity, t, v, n, isgap = 1 AS gap, seg::BIGINT AS seg, pos FROM s")
def contiguity_segments(tb):
    return hourly(tb).select("entity", "t", "v", "n", "gap", "seg", "pos")


@query(f"WITH {grid_sql(H)}, x AS (SELECT entity, lag(t) OVER (PARTITION BY entity ORDER BY t) AS after, t AS before FROM g) SELECT entity, after, before, (before - after) // {H} - 1 AS missing_slots FROM x WHERE before - after > {H}")
def gap_report(tb):
    return series.gaps(series.grid(tb.events, H), H)


@query(f"WITH {grid_sql(H)}, {seg_sql(H)} SELECT entity, max(pos) AS longest, max(seg)::BIGINT AS segments, count(*) AS samples FROM s GROUP BY entity")
def longest_streak(tb):
    return series.longest_streak(hourly(tb))


_ALARM = "entity, start AS run_start, min(t) AS trigger_at, max(t) AS last_positive_at, count(*) AS positive_samples, arg_min(v, t) AS trigger_value, min(v) AS min_value, max(v) AS max_value"


@query(f"WITH {LIMITS_SQL}, {grid_sql(H)}, {seg_sql(H)}, sl AS (SELECT s.*, nominal, warn, crit, lo FROM s JOIN lim USING (entity)), {run_sql('v > warn', 'sl')} SELECT {_ALARM} FROM r GROUP BY entity, start")
def threshold_alarms(tb):
    return series.persistent(series.with_runs(limited(tb), "v > warn"))


@query(f"WITH {grid_sql(H)}, {seg_sql(H)}, {run_sql('v > 60')} SELECT {_ALARM} FROM r WHERE t - start > {2 * H} GROUP BY entity, start")
def persistent_alarms(tb):
    return series.persistent(series.with_runs(hourly(tb), "v > 60"), F.lit(2 * H))


_RULES = [("W-click", "click", "gt", 110.0, None, 0), ("L-error", "error", "lt", 60.0, None, H), ("O-view", "view", "outside", 40.0, 120.0, 2 * H), ("W-signup", "signup", "gt", 80.0, None, H), ("O-purchase", "purchase", "outside", 35.0, 110.0, 0)]
_RULES_SQL = "rules(rule_id, entity, op, lo, hi, dur) AS (VALUES " + ", ".join(f"('{r}', '{e}', '{o}', {v}, {s or 'NULL'}, {d})" for r, e, o, v, s, d in _RULES) + ")"


@query(
    f"WITH {_RULES_SQL}, {grid_sql(H)}, {seg_sql(H)}, sr AS (SELECT s.*, rule_id, op, lo, hi, dur FROM s JOIN rules USING (entity)), {run_sql('CASE op WHEN $$gt$$ THEN v > lo WHEN $$lt$$ THEN v < lo ELSE v < lo OR v > hi END', 'sr')}"
    " SELECT rule_id, entity, start AS run_start, min(t) AS trigger_at, max(t) AS last_positive_at, count(*) AS positive_samples, arg_min(v, t) AS trigger_value FROM r WHERE dur = 0 OR t - start > dur GROUP BY rule_id, entity, start"
)
def rule_table_alarms(tb):
    """Each rule's operation is a row of data; one rule a series here, so the key stays the entity."""
    rt = tb.rows(_RULES, "rule_id string, entity string, op string, lo double, hi double, dur int")
    s = hourly(tb).join(F.broadcast(rt), "entity")
    r = series.with_runs(s, rules.violates(F.col("op"), F.col("v"), F.col("lo"), F.col("hi")), ("entity", "rule_id"))
    return series.persistent(r, "dur", ("entity", "rule_id")).drop("min_value", "max_value")


def _counted_sql(cond: str, n: int, src: str = "s", offset: int = 0) -> str:
    return f"{run_sql(cond, src)} SELECT entity, start AS run_start, min(t) AS trigger_at, max(t) AS last_positive_at, count(*) AS positive_samples, arg_min(v, t) AS trigger_value, start - {offset} AS condition_start FROM r WHERE rn >= {n} GROUP BY entity, start"


@query(f"WITH {LIMITS_SQL}, {grid_sql(H)}, {seg_sql(H)}, sl AS (SELECT s.*, nominal, warn, crit, lo FROM s JOIN lim USING (entity)), {_counted_sql('v < lo * 2 OR v > warn', 3, 'sl')}")
def out_of_range_runs(tb):
    return series.counted_runs(series.with_runs(limited(tb), "v < lo * 2 OR v > warn"), 3, H)


@query(f"WITH {LIMITS_SQL}, {grid_sql(H)}, {seg_sql(H)}, sl AS (SELECT s.*, nominal, warn, crit, lo FROM s JOIN lim USING (entity)), {_counted_sql('abs(v - nominal) > 20', 4, 'sl')}")
def sustained_deviation(tb):
    """Three hours of deviation from nominal: 3 h / step + 1 samples."""
    return series.counted_runs(series.with_runs(limited(tb), "abs(v - nominal) > 20"), 3 * H // H + 1, H)


@query(f"WITH {LIMITS_SQL}, {grid_sql(H)}, {seg_sql(H)}, sl AS (SELECT s.*, nominal, warn, crit, lo FROM s JOIN lim USING (entity)), {_counted_sql('v < lo * 1.5', 1, 'sl').replace('start - 0 AS condition_start', 'start AS condition_start, $$precondition_unobserved$$ AS flag')}")
def partial_rule_runs(tb):
    return series.counted_runs(series.with_runs(limited(tb), "v < lo * 1.5"), 1, H).withColumn("flag", F.lit("precondition_unobserved"))


@query(
    f"WITH {grid_sql(H)}, {seg_sql(H)}, a AS (SELECT *, CASE WHEN isgap = 1 OR n IS DISTINCT FROM lag(n) OVER (PARTITION BY entity ORDER BY t) THEN 1 ELSE 0 END AS nw FROM s), b AS (SELECT *, sum(nw) OVER (PARTITION BY entity ORDER BY t) AS rid FROM a),"
    " c AS (SELECT *, row_number() OVER (PARTITION BY entity, rid ORDER BY t) AS rn, min(t) OVER (PARTITION BY entity, rid) AS start FROM b)"
    " SELECT entity, start AS run_start, n AS stuck_value, min(t) AS trigger_at, max(t) AS last_positive_at, count(*) AS positive_samples FROM c WHERE rn >= 3 GROUP BY entity, start, n"
)
def stuck_exact_runs(tb):
    return series.stuck_exact(hourly(tb), 3, H, value="n")


_STD = "CASE WHEN pos >= 4 THEN stddev_pop(v) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END"


@query(f"WITH {grid_sql(H)}, {seg_sql(H)}, f AS (SELECT *, {_STD} AS sd FROM s), {_counted_sql('sd < 20', 1, 'f', 3 * H)}")
def stuck_std_runs(tb):
    return series.counted_runs(series.with_runs(series.rolling_std(hourly(tb), 4), "std < 20"), 1, H, offset=3 * H)


@query(
    f"WITH {grid_sql(H)}, {seg_sql(H)}, f AS (SELECT *, CASE WHEN pos >= 6 THEN regr_slope(v, pos::DOUBLE) OVER w END AS sl, CASE WHEN pos >= 6 THEN avg(v) OVER w END AS m FROM s WINDOW w AS (PARTITION BY entity ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))"
    " SELECT entity, t, round(sl, 6) AS slope, round(m + sl * 2.5, 6) AS fitted_end FROM f WHERE pos >= 6"
)
def rolling_slope(tb):
    return series.rolling_slope(hourly(tb), 6).where("pos >= 6").select("entity", "t", F.round("slope_per_step", 6).alias("slope"), F.round("fitted_end", 6).alias("fitted_end"))


_SIGMA = "sig AS (SELECT entity, count(*) AS samples, median(v) AS med, stddev_pop(v) AS sd FROM g WHERE t < {0} GROUP BY entity), mad AS (SELECT entity, median(abs(v - med)) AS mad FROM g JOIN sig USING (entity) WHERE t < {0} GROUP BY entity), sigma AS (SELECT entity, samples, CASE WHEN mad > 0 THEN 1.4826 * mad ELSE sd END AS sigma FROM sig JOIN mad USING (entity))"
CUT = 1_705_276_800  # 2024-01-15


@query(
    f"WITH {LIMITS_SQL}, {grid_sql(H)}, {_SIGMA.format(CUT)}, {seg_sql(H)}, f AS (SELECT s.*, CASE WHEN pos >= 6 THEN regr_slope(v, pos::DOUBLE) OVER w END AS sl, CASE WHEN pos >= 6 THEN avg(v) OVER w END AS m FROM s WINDOW w AS (PARTITION BY entity ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)), x AS (SELECT f.*, sigma, nominal FROM f JOIN sigma USING (entity) JOIN lim USING (entity)),"
    f" {_counted_sql('abs(sl) > 0.2 * sigma AND sign(m + sl * 2.5 - nominal) = sign(sl)', 2, 'x', 5 * H)}"
)
def slope_alarms(tb):
    """Slopes beyond 0.2 sigma a step that point away from nominal, twice in a row."""
    g = series.grid(tb.events, H)
    x = series.rolling_slope(series.with_segments(g, H), 6).join(series.robust_sigma(g, CUT), "entity").join(F.broadcast(limits(tb)), "entity")
    r = series.with_runs(x, (F.col("sigma") > 0) & (F.abs("slope_per_step") > 0.2 * F.col("sigma")) & (F.signum(F.col("fitted_end") - F.col("nominal")) == F.signum("slope_per_step")))
    return series.counted_runs(r, 2, H, offset=5 * H)


_CHANGE = "f AS (SELECT *, CASE WHEN pos >= 6 THEN avg(v) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) END AS nw, CASE WHEN pos >= 6 THEN avg(v) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN 5 PRECEDING AND 4 PRECEDING) END AS bf FROM s)"


@query(f"WITH {grid_sql(H)}, {seg_sql(H)}, {_CHANGE} SELECT entity, t, round(nw, 6) AS now, round(bf, 6) AS before, abs(nw - bf) > 50 AS hit FROM f WHERE pos >= 6")
def window_change(tb):
    x = series.window_change(hourly(tb), 4, 2).where("pos >= 6")
    return x.select("entity", "t", F.round("now", 6).alias("now"), F.round("before", 6).alias("before"), (F.abs(F.col("now") - F.col("before")) > 50).alias("hit"))


@query(f"WITH {LIMITS_SQL}, {grid_sql(H)}, {seg_sql(H)}, {_CHANGE}, x AS (SELECT f.*, nominal FROM f JOIN lim USING (entity)), {_counted_sql('abs(nw - bf) > 40 AND abs(nw - nominal) > abs(bf - nominal)', 1, 'x')}")
def window_change_away(tb):
    x = series.window_change(hourly(tb), 4, 2).join(F.broadcast(limits(tb)), "entity")
    return series.counted_runs(series.with_runs(x, "abs(now - before) > 40 AND abs(now - nominal) > abs(before - nominal)"), 1, H)


@query(f"WITH {grid_sql(H)}, {seg_sql(H)} SELECT entity, t, round(v - lag(v, 3) OVER (PARTITION BY entity ORDER BY t), 6) AS delta FROM s QUALIFY pos > 3 AND v - lag(v, 3) OVER (PARTITION BY entity ORDER BY t) > 30")
def delta_lookback(tb):
    return series.delta_lookback(hourly(tb), 3).where("delta > 30").select("entity", "t", F.round("delta", 6).alias("delta"))


@query(f"WITH {grid_sql(H)}, {_SIGMA.format(CUT)} SELECT entity, samples, round(sigma, 6) AS sigma FROM sigma")
def robust_sigma(tb):
    return series.robust_sigma(series.grid(tb.events, H), CUT).withColumn("sigma", F.round("sigma", 6))


@query(f"WITH {grid_sql(H)}, {seg_sql(H)} SELECT entity, count(*) FILTER (t < {CUT}) AS history, count(*) FILTER (t >= {CUT}) AS target, arg_min(pos, t) FILTER (t >= {CUT}) - 1 AS contiguous_prior FROM s GROUP BY entity")
def warm_up_context(tb):
    return series.warm_up(hourly(tb), CUT)


# Alarms of three kinds, and incidents.

_KINDS = (("kg_threshold_warning", "WARN", "v > warn", 1), ("kg_threshold_critical", "CRIT", "v > crit", 1), ("sop002_out_of_range", "OOR", "v < lo * 2 OR v > warn", 3), ("kg_maint_drift", "DRIFT", "abs(v - nominal) > 30", 4))


def alarm_rules(tb: Tables) -> DataFrame:
    """The rules of _KINDS for every entity, in the executor's form."""
    lim = limits(tb)

    def rule(k: int, name: str, value, second=None, op=None, readings=None) -> DataFrame:
        kind, rule_id = _KINDS[k][:2]
        null = F.lit(None)
        return lim.select(F.lit(rule_id).alias("rule_id"), F.lit(kind).alias("kind"), "entity", F.lit(name).alias("executor"), F.lit(op).alias("op"), value.alias("value"), (null if second is None else second).cast("double").alias("second"), F.lit(readings).cast("int").alias("readings"), "nominal")

    warn, crit, lo = F.col("warn"), F.col("crit"), F.col("lo")
    return executor.normalise(
        rule(0, "threshold_scan", warn, op="gt"), rule(1, "threshold_scan", crit, op="gt"), rule(2, "outside_run", lo * 2, warn, readings=_KINDS[2][3]), rule(3, "sustained_from_nominal", F.lit(30.0), readings=_KINDS[3][3])
    )


def alarms(tb: Tables) -> DataFrame:
    """Alarms of every kind over one shared series, in one pass; alarm_id names kind, entity and time."""
    return executor.execute(hourly(tb), alarm_rules(tb), None, H).drop("flag")


_PARTS = [f"{run_sql(c, 'sl', f'k{i}r')}, k{i} AS (SELECT entity, start AS run_start, min(t) AS trigger_at, max(t) AS last_positive_at, count(*) AS positive_samples, arg_min(v, t) AS trigger_value, '{k}' AS kind, '{r}' AS rule_id FROM k{i}r WHERE rn >= {n} GROUP BY entity, start)" for i, (k, r, c, n) in enumerate(_KINDS)]
ALARMS_SQL = f"{LIMITS_SQL}, {grid_sql(H)}, {seg_sql(H)}, sl AS (SELECT s.*, nominal, warn, crit, lo FROM s JOIN lim USING (entity)), {', '.join(_PARTS)}, al AS (SELECT *, rule_id || '-' || entity || '-' || trigger_at AS alarm_id FROM ({' UNION ALL '.join(f'SELECT * FROM k{i}' for i in range(len(_KINDS)))}))"
GAP = 2 * H
SESSIONS_SQL = f"{ALARMS_SQL}, se0 AS (SELECT *, CASE WHEN trigger_at <= max(last_positive_at) OVER (PARTITION BY entity ORDER BY trigger_at, alarm_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {GAP} THEN 0 ELSE 1 END AS nw FROM al), se AS (SELECT *, sum(nw) OVER (PARTITION BY entity ORDER BY trigger_at, alarm_id)::BIGINT AS session FROM se0)"
SEVERITY_SQL = "max(CASE WHEN kind = 'kg_threshold_critical' THEN 2 WHEN kind IN ('kg_threshold_warning', 'sop002_out_of_range') THEN 1 ELSE 0 END)"
INCIDENTS_SQL = f"{SESSIONS_SQL}, inc AS (SELECT entity, session, min(trigger_at) AS start, max(last_positive_at) AS \"end\", min(run_start) AS onset_estimate, count(*) AS alarms, list_sort(list(DISTINCT kind)) AS kinds, list_sort(list(DISTINCT rule_id)) AS rule_ids, list_sort(list(DISTINCT alarm_id)) AS alarm_ids, {SEVERITY_SQL} AS sev FROM se GROUP BY entity, session)"


def sessioned(tb: Tables) -> DataFrame:
    return links.sessions(alarms(tb), GAP, tie=("alarm_id",))


@query(f"WITH {ALARMS_SQL} SELECT alarm_id, entity, kind, rule_id, run_start, trigger_at, last_positive_at, positive_samples, trigger_value FROM al")
def all_alarms(tb):
    return alarms(tb).select("alarm_id", "entity", "kind", "rule_id", "run_start", "trigger_at", "last_positive_at", "positive_samples", "trigger_value")


@query(f"WITH {ALARMS_SQL} SELECT kind, count(*) AS alarms, count(DISTINCT entity) AS entities FROM al GROUP BY kind")
def alarms_by_kind(tb):
    return alarms(tb).groupBy("kind").agg(F.count("*").alias("alarms"), F.count_distinct("entity").alias("entities"))


@query(f"WITH {SESSIONS_SQL} SELECT alarm_id, entity, session FROM se")
def incident_sessions(tb):
    return sessioned(tb).select("alarm_id", "entity", F.col("session").cast("long").alias("session"))


@query(f"WITH {INCIDENTS_SQL} SELECT entity, session, start, \"end\", onset_estimate, alarms, array_to_string(kinds, ',') AS kinds, array_to_string(rule_ids, ',') AS rule_ids, array_to_string(alarm_ids, ',') AS alarm_ids, ['ADVISORY', 'WARNING', 'CRITICAL'][sev + 1] AS severity FROM inc")
def incident_summary(tb):
    out = links.incidents(sessioned(tb))
    return out.withColumns({c: F.array_join(c, ",") for c in ("kinds", "rule_ids", "alarm_ids")} | {"session": F.col("session").cast("long")})


@query(f"WITH {SESSIONS_SQL}, tags(rule_id, tag) AS (VALUES ('DRIFT', 'CRITICAL'), ('WARN', 'WARNING')) SELECT entity, session, ['ADVISORY', 'WARNING', 'CRITICAL'][greatest({SEVERITY_SQL}, coalesce(max(CASE tag WHEN 'CRITICAL' THEN 2 WHEN 'WARNING' THEN 1 END), 0)) + 1] AS severity FROM se LEFT JOIN tags USING (rule_id) GROUP BY entity, session")
def incident_severity(tb):
    tags = tb.rows([("DRIFT", "CRITICAL"), ("WARN", "WARNING")], "rule_id string, tag string")
    return links.incidents(sessioned(tb).join(tags, "rule_id", "left"), tag="tag").select("entity", F.col("session").cast("long").alias("session"), "severity")


TYPE_SQL = "CASE WHEN bool_or(kind = 'sop002_stuck_std') THEN 'STUCK' WHEN bool_or(kind = 'kg_threshold_critical') AND max(last_positive_at) FILTER (kind LIKE 'kg_threshold%' OR kind = 'sop002_out_of_range') - min(trigger_at) FILTER (kind LIKE 'kg_threshold%' OR kind = 'sop002_out_of_range') < 7200 THEN 'SPIKE' WHEN bool_or(kind = 'kg_maint_drift') AND (count(*) FILTER (kind <> 'kg_maint_drift') = 0 OR min(trigger_at) FILTER (kind = 'kg_maint_drift') < min(trigger_at) FILTER (kind <> 'kg_maint_drift') OR NOT bool_or(kind = 'sop002_out_of_range')) THEN 'DRIFT' WHEN bool_or(kind = 'sop002_out_of_range') THEN 'OUT_OF_RANGE' ELSE 'UNCLASSIFIED' END"


@query(f"WITH {SESSIONS_SQL} SELECT entity, session, {TYPE_SQL} AS anomaly_type FROM se GROUP BY entity, session")
def incident_types(tb):
    return links.classify(sessioned(tb), spike_seconds=7200).withColumn("session", F.col("session").cast("long"))


@query(f"WITH {ALARMS_SQL}, ep0 AS (SELECT *, CASE WHEN trigger_at <= max(last_positive_at) OVER (PARTITION BY entity ORDER BY trigger_at, alarm_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM al), ep AS (SELECT *, sum(nw) OVER (PARTITION BY entity ORDER BY trigger_at, alarm_id) AS e FROM ep0) SELECT entity, min(trigger_at) AS start, max(last_positive_at) AS \"end\", count(*) AS alarms FROM ep GROUP BY entity, e")
def episodes(tb):
    s = links.sessions(alarms(tb), 0, tie=("alarm_id",))
    return s.groupBy("entity", "session").agg(F.min("trigger_at").alias("start"), F.max("last_positive_at").alias("end"), F.count("*").alias("alarms")).drop("session")


def incident_rows(tb: Tables) -> DataFrame:
    return links.incidents(sessioned(tb)).withColumn("incident_id", F.concat_ws("#", "entity", F.col("session").cast("string")))


_SIGNALS = "sgr0 AS (SELECT * FROM sl), {run}, sg AS (SELECT entity, start AS run_start, min(t) AS trigger_at, max(t) AS last_positive_at, arg_min(v, t) AS trigger_value, 'S-' || entity || '-' || min(t) AS signal_id FROM sigr WHERE rn >= 2 GROUP BY entity, start)".format(run=run_sql("abs(v - nominal) > 15", "sgr0", "sigr"))


def signals(tb: Tables) -> DataFrame:
    s = series.counted_runs(series.with_runs(limited(tb), "abs(v - nominal) > 15"), 2, H)
    return s.withColumn("signal_id", F.concat_ws("-", F.lit("S"), "entity", F.col("trigger_at").cast("string")))


@query(f"WITH {INCIDENTS_SQL}, {_SIGNALS} SELECT inc.entity, session, signal_id FROM inc JOIN sg ON inc.entity = sg.entity AND sg.trigger_at <= inc.\"end\" AND sg.last_positive_at >= inc.start - {GAP}")
def signal_attachment(tb):
    return links.attach_signals(signals(tb), links.incidents(sessioned(tb)), GAP).withColumn("session", F.col("session").cast("long"))


@query(
    f"WITH {INCIDENTS_SQL}, {PAIRS_SQL}, x AS (SELECT e.entity || '#' || e.session AS effect_id, e.entity AS effect, e.start, c.entity || '#' || c.session AS cause_id, c.entity AS cause, c.start AS cause_start FROM inc e JOIN pairs ON pairs.effect = e.entity JOIN inc c ON c.entity = pairs.cause AND c.start BETWEEN e.start - \"within\" AND e.start)"
    " SELECT effect_id, effect, start, cause_id, cause, cause_start, start - cause_start AS lag FROM x QUALIFY row_number() OVER (PARTITION BY effect_id ORDER BY cause_start DESC, cause_id DESC) = 1"
)
def correlation_links(tb):
    inc = incident_rows(tb)
    return links.as_of(inc.select(F.col("incident_id").alias("effect_id"), F.col("entity").alias("effect"), "start"), inc.select(F.col("incident_id").alias("cause_id"), F.col("entity").alias("cause"), F.col("start").alias("cause_start")), pairs(tb))


ANCHORS_SQL = "anc AS (SELECT entity || '#' || session AS cause_id, entity AS cause, min(trigger_at) AS anchor FROM se WHERE kind = 'kg_threshold_warning' GROUP BY entity, session)"


def anchors(tb: Tables) -> DataFrame:
    """Incidents with a warning, anchored at their first."""
    s = sessioned(tb).where("kind = 'kg_threshold_warning'")
    return s.groupBy("entity", "session").agg(F.min(F.struct("trigger_at", "alarm_id"))["trigger_at"].alias("anchor")).select(F.concat_ws("#", "entity", F.col("session").cast("string")).alias("cause_id"), F.col("entity").alias("cause"), "anchor")


@query(f"WITH {SESSIONS_SQL}, {ANCHORS_SQL} SELECT cause_id, cause, anchor FROM anc")
def warning_anchors(tb):
    return anchors(tb)


@query(
    f"WITH {SESSIONS_SQL}, {ANCHORS_SQL}, {_SIGNALS}, {PAIRS_SQL}, x AS (SELECT signal_id, effect, trigger_at, cause_id AS monitored_by, anchor AS window_start FROM sg JOIN pairs ON effect = sg.entity JOIN anc USING (cause) JOIN lim ON lim.entity = effect WHERE trigger_at BETWEEN anchor AND anchor + \"within\" AND CASE direction WHEN 'above_nominal' THEN trigger_value > nominal ELSE trigger_value < nominal END)"
    " SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY signal_id ORDER BY window_start DESC, monitored_by DESC) = 1"
)
def monitor_promotion(tb):
    sig = signals(tb).join(F.broadcast(limits(tb).select("entity", "nominal")), "entity")
    return links.promote(sig, anchors(tb), pairs(tb), F.col("nominal"))


@query(
    f"WITH {SESSIONS_SQL}, {ANCHORS_SQL}, {PAIRS_SQL}, eff AS (SELECT entity || '#' || session AS effect_id, entity AS effect, min(trigger_at) AS start, max(trigger_value) AS high, min(trigger_value) AS low FROM se GROUP BY entity, session),"
    " x AS (SELECT effect_id, effect, start, cause_id, cause, anchor FROM eff JOIN pairs USING (effect) JOIN anc USING (cause) JOIN lim ON lim.entity = effect WHERE anchor BETWEEN start - \"within\" AND start AND CASE direction WHEN 'above_nominal' THEN high > nominal ELSE low < nominal END)"
    " SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY effect_id ORDER BY anchor DESC, cause_id DESC) = 1"
)
def verified_links(tb):
    eff = sessioned(tb).groupBy("entity", "session").agg(F.min("trigger_at").alias("start"), F.max("trigger_value").alias("high"), F.min("trigger_value").alias("low"))
    eff = eff.join(F.broadcast(limits(tb).select("entity", "nominal")), "entity").select(F.concat_ws("#", "entity", F.col("session").cast("string")).alias("effect_id"), F.col("entity").alias("effect"), "start", "high", "low", "nominal", F.array().cast("array<string>").alias("monitors"))
    return links.verified_links(eff, anchors(tb), pairs(tb), F.col("nominal"))


# Evaluation.

_LABEL = "CASE WHEN v > 150 THEN 'SPIKE' WHEN v < 35 THEN 'LOW' ELSE 'NORMAL' END"
GOLD_SQL = f"{grid_sql(H, 'gg')}, lb AS (SELECT *, {_LABEL} AS label FROM gg), lb1 AS (SELECT *, CASE WHEN t - lag(t) OVER w = {H} AND label = lag(label) OVER w THEN 0 ELSE 1 END AS nw FROM lb WINDOW w AS (PARTITION BY entity ORDER BY t)), lb2 AS (SELECT *, sum(nw) OVER (PARTITION BY entity ORDER BY t) AS rid FROM lb1), gold AS (SELECT entity, label, min(t) AS start, max(t) AS \"end\", count(*) AS samples, entity || '@' || min(t) AS gold_id FROM lb2 WHERE label <> 'NORMAL' GROUP BY entity, label, rid)"


def gold(tb: Tables) -> DataFrame:
    g = series.grid(tb.events, H).withColumn("label", F.expr(_LABEL))
    return evaluate.gold_events(g, "label", H).withColumn("gold_id", F.concat_ws("@", "entity", F.col("start").cast("string")))


def found(tb: Tables) -> DataFrame:
    return incident_rows(tb).select(F.col("incident_id").alias("found_id"), "entity", F.col("start").alias("f_start"), F.col("end").alias("f_end"))


FOUND_SQL = "fnd AS (SELECT entity || '#' || session AS found_id, entity, start AS f_start, \"end\" AS f_end FROM inc)"
HITS_SQL = "hit AS (SELECT gold.*, found_id, f_start, f_end, f_start - start AS latency FROM gold JOIN fnd ON gold.entity = fnd.entity AND f_start <= \"end\" + 3600 AND f_end >= start)"
EVAL_SQL = f"{INCIDENTS_SQL}, {GOLD_SQL}, {FOUND_SQL}, {HITS_SQL}"


@query(f"WITH {GOLD_SQL} SELECT entity, label, start, \"end\", samples, gold_id FROM gold")
def gold_events(tb):
    return gold(tb)


@query(f"WITH {EVAL_SQL} SELECT gold_id, found_id, latency FROM hit")
def event_overlap(tb):
    return evaluate.event_hits(gold(tb), found(tb), H).select("gold_id", "found_id", "latency")


@query(
    f"WITH {EVAL_SQL}, fl AS (SELECT gold_id, min(latency) AS latency FROM hit GROUP BY gold_id), c AS (SELECT (SELECT count(*) FROM gold) AS golds, (SELECT count(*) FROM fl) AS caught, (SELECT count(*) FROM fnd) AS alarms, (SELECT count(DISTINCT found_id) FROM hit) AS good)"
    " SELECT golds, caught, round(caught / golds, 6) AS recall, alarms, alarms - good AS false_alarms, round(good / alarms, 6) AS precision, (SELECT median(latency) FROM fl)::DOUBLE AS median_latency, (SELECT list_sort(list(latency))[(count(*) // 2 + 1)::INT] FROM fl) AS upper_median_latency FROM c"
)
def event_overlap_eval(tb):
    return evaluate.event_scores(gold(tb), found(tb), H)


@query(f"WITH {EVAL_SQL} SELECT found_id, entity, f_start, f_end FROM fnd WHERE found_id NOT IN (SELECT found_id FROM hit)")
def false_alarms(tb):
    f = found(tb)
    return f.join(evaluate.event_hits(gold(tb), found(tb), H).select("found_id"), "found_id", "left_anti")


@query(f"WITH {EVAL_SQL}, ty AS (SELECT entity || '#' || session AS found_id, {TYPE_SQL} AS anomaly_type FROM se GROUP BY entity, session), f1 AS (SELECT gold_id, label, found_id FROM hit QUALIFY row_number() OVER (PARTITION BY gold_id ORDER BY f_start, found_id) = 1) SELECT label, count(*) FILTER (anomaly_type = 'SPIKE') AS spike, count(*) FILTER (anomaly_type = 'DRIFT') AS drift, count(*) FILTER (anomaly_type = 'OUT_OF_RANGE') AS out_of_range, count(*) FILTER (anomaly_type = 'UNCLASSIFIED') AS unclassified FROM f1 JOIN ty USING (found_id) GROUP BY label")
def type_confusion(tb):
    ty = links.classify(sessioned(tb), spike_seconds=7200).select(F.concat_ws("#", "entity", F.col("session").cast("string")).alias("found_id"), "anomaly_type")
    first = evaluate.event_hits(gold(tb), found(tb), H).groupBy("gold_id", "label").agg(F.min(F.struct("f_start", "found_id"))["found_id"].alias("found_id"))
    j = first.join(ty, "found_id")
    return j.groupBy("label").agg(*[F.count_if(F.col("anomaly_type") == k).alias(k.lower()) for k in ("SPIKE", "DRIFT", "OUT_OF_RANGE", "UNCLASSIFIED")])


@query(
    f"WITH {LIMITS_SQL}, {grid_sql(H)}, x AS (SELECT CASE WHEN t < {CUT} THEN 'train' WHEN t < {CUT + 7 * DAY} THEN 'validation' ELSE 'test' END AS part, v > 150 AS truth, v > crit - 40 AS guess FROM g JOIN lim USING (entity)), c AS (SELECT part, count(*) FILTER (truth AND guess) AS tp, count(*) FILTER (NOT truth AND guess) AS fp, count(*) FILTER (truth AND NOT guess) AS fn, count(*) FILTER (NOT truth AND NOT guess) AS tn FROM x GROUP BY part)"
    " SELECT part, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c"
)
def row_prf(tb):
    g = series.grid(tb.events, H).join(F.broadcast(limits(tb)), "entity").withColumn("part", F.when(F.col("t") < CUT, "train").when(F.col("t") < CUT + 7 * DAY, "validation").otherwise("test"))
    return evaluate.row_scores(g, F.col("v") > 150, F.col("v") > F.col("crit") - 40, ["part"])


@query(f"WITH {ALARMS_SQL} SELECT entity, count(*) AS alarms, round(count(*) / 30.0, 3) AS alarms_per_day, count(DISTINCT kind) AS kinds, round(avg(positive_samples), 3) AS mean_samples FROM al GROUP BY entity")
def label_free_metrics(tb):
    return alarms(tb).groupBy("entity").agg(F.count("*").alias("alarms"), F.round(F.count("*") / 30.0, 3).alias("alarms_per_day"), F.count_distinct("kind").alias("kinds"), F.round(F.avg("positive_samples"), 3).alias("mean_samples"))


@query(f"WITH {EVAL_SQL}, fl AS (SELECT gold.gold_id, gold.label, min(latency) AS latency FROM gold LEFT JOIN hit ON gold.gold_id = hit.gold_id GROUP BY 1, 2) SELECT coalesce(label, 'ALL') AS label, count(*) AS golds, count(latency) AS caught, median(latency)::DOUBLE AS median_latency FROM fl GROUP BY GROUPING SETS ((label), ())")
def benchmark_grouping_sets(tb):
    g = gold(tb)
    lat = evaluate.event_hits(g, found(tb), H).groupBy("gold_id").agg(F.min("latency").alias("latency"))
    rows = g.join(lat, "gold_id", "left")
    return rows.rollup("label").agg(F.count("gold_id").alias("golds"), F.count("latency").alias("caught"), F.percentile("latency", 0.5).alias("median_latency")).withColumn("label", F.coalesce("label", F.lit("ALL")))


@query(
    f"WITH {LIMITS_SQL}, {grid_sql(H)}, {seg_sql(H)}, sl AS (SELECT s.*, nominal, warn, crit, lo FROM s JOIN lim USING (entity)), {run_sql('v > crit', 'sl')}, al AS (SELECT entity, min(t) AS a, max(t) AS b FROM r GROUP BY entity, start),"
    f" w AS (SELECT entity, pos, min(t) OVER f AS start, t AS \"end\", min(CASE WHEN v BETWEEN 20 AND 180 THEN 1 ELSE 0 END) OVER f AS inside FROM s WINDOW f AS (PARTITION BY entity ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))"
    f' SELECT entity, start, "end" FROM w WHERE pos >= 4 AND (pos - 4) % 2 = 0 AND inside = 1 AND NOT EXISTS (SELECT 1 FROM al WHERE al.entity = w.entity AND a - {H} < "end" AND b + {H} > start)'
)
def clean_host_windows(tb):
    al = series.persistent(series.with_runs(limited(tb), "v > crit"))
    return series.clean_windows(hourly(tb), al, 4, 2, 20.0, 180.0, H)


_INJECT = [("click", 1_704_300_000, 1_704_310_800, "SPIKE", 300.0), ("error", 1_705_000_000, 1_705_050_000, "STUCK", 77.0), ("view", 1_705_600_000, 1_705_700_000, "DRIFT", 0.001)]
_INJECT_SQL = "inj(entity, a, b, kind, size) AS (VALUES " + ", ".join(f"('{e}', {a}, {b}, '{k}', {s})" for e, a, b, k, s in _INJECT) + ")"


@query(f"WITH {_INJECT_SQL}, {grid_sql(H)} SELECT g.entity, t, round(CASE kind WHEN 'SPIKE' THEN v + size WHEN 'STUCK' THEN size WHEN 'DRIFT' THEN v + size * (t - a) ELSE v END, 6) AS v, coalesce(kind, 'NORMAL') AS label FROM g LEFT JOIN inj ON g.entity = inj.entity AND t BETWEEN a AND b")
def synthetic_injection(tb):
    inj = tb.rows(_INJECT, "e string, a long, b long, kind string, size double")
    g = series.grid(tb.events, H)
    j = g.join(F.broadcast(inj), (g["entity"] == F.col("e")) & F.col("t").between(F.col("a"), F.col("b")), "left")
    v = F.when(F.col("kind") == "SPIKE", F.col("v") + F.col("size")).when(F.col("kind") == "STUCK", F.col("size")).when(F.col("kind") == "DRIFT", F.col("v") + F.col("size") * (F.col("t") - F.col("a"))).otherwise(F.col("v"))
    return j.select("entity", "t", F.round(v, 6).alias("v"), F.coalesce("kind", F.lit("NORMAL")).alias("label"))


@query(f"WITH {INCIDENTS_SQL} SELECT entity || '#' || session AS incident_id, start, row_number() OVER (ORDER BY start, entity) AS n, count(*) OVER () AS total FROM inc WHERE sev >= 1 QUALIFY row_number() OVER (ORDER BY start, entity) BETWEEN 11 AND 20")
def paged_listing(tb):
    """The second page of ten, by (start, id). The page comes from a bounded top-k, the total from a count."""
    rows = incident_rows(tb).where("severity IN ('WARNING', 'CRITICAL')").select("incident_id", "start", "entity")
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy("start", "entity").limit(20).withColumn("n", F.row_number().over(W.orderBy("start", "entity"))).where("n > 10")
    return page.crossJoin(F.broadcast(total)).select("incident_id", "start", F.col("n").cast("long").alias("n"), "total")


@query("WITH x AS (SELECT event_id, epoch_us(ts) // 1000000 AS t, value FROM events WHERE user_id = 7 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25') SELECT event_id, t, value, count(*) OVER () AS total, CASE WHEN count(*) OVER () > 30 THEN 30 END AS next_offset FROM x QUALIFY row_number() OVER (ORDER BY t, event_id) BETWEEN 11 AND 30")
def series_page(tb):
    x = tb.events.where("user_id = 7 AND ts >= TIMESTAMP_NTZ'2024-01-05' AND ts < TIMESTAMP_NTZ'2024-01-25'").select("event_id", series.seconds("ts").alias("t"), "value")
    total = x.agg(F.count("*").alias("total"))
    page = x.orderBy("t", "event_id").limit(30).withColumn("n", F.row_number().over(W.orderBy("t", "event_id"))).where("n > 10")
    return page.crossJoin(F.broadcast(total)).select("event_id", "t", "value", "total", F.when(F.col("total") > 30, F.lit(30)).alias("next_offset"))


@query(f"WITH {INCIDENTS_SQL} SELECT entity || '#' || session AS incident_id, CASE WHEN \"end\" < {CUT} THEN 'warmup_only' WHEN start < {CUT} THEN 'started_before_analysis' ELSE 'started_in_analysis' END AS scope FROM inc")
def incident_scopes(tb):
    return incident_rows(tb).select("incident_id", series.scope(F.col("start"), F.col("end"), CUT).alias("scope"))


@query(f"WITH {ALARMS_SQL}, s2 AS (SELECT * FROM s) SELECT alarm_id, (SELECT min(t) FROM s2 WHERE s2.entity = al.entity AND s2.t > al.last_positive_at) AS first_after, CASE WHEN (SELECT min(t) FROM s2 WHERE s2.entity = al.entity AND s2.t > al.last_positive_at) IS NULL THEN 'open_at_data_end' WHEN (SELECT min(t) FROM s2 WHERE s2.entity = al.entity AND s2.t > al.last_positive_at) - al.last_positive_at > {H} THEN 'data_gap_unconfirmed' ELSE 'recovered' END AS closure FROM al")
def alarm_closures(tb):
    """How each alarm ended: by a sample without it, by a gap, or with the data."""
    nxt = hourly(tb).select(F.col("entity"), F.col("t").alias("last_positive_at"), F.lead("t").over(W.partitionBy("entity").orderBy("t")).alias("first_after"))
    j = alarms(tb).join(nxt, ["entity", "last_positive_at"], "left")
    kind = F.when(F.col("first_after").isNull(), "open_at_data_end").when(F.col("first_after") - F.col("last_positive_at") > H, "data_gap_unconfirmed").otherwise("recovered")
    return j.select("alarm_id", "first_after", kind.alias("closure"))


@query(f"WITH {grid_sql(H)}, {seg_sql(H)}, {run_sql('v > 60')}, a AS (SELECT entity, start, min(t) FILTER (t - start > {2 * H}) AS trigger_at FROM r GROUP BY entity, start) SELECT a.entity, a.start, a.trigger_at, count(*) FILTER (r.t <= a.trigger_at) AS samples_before, count(*) FILTER (r.t <= a.trigger_at AND r.t - r.start > {2 * H}) AS qualifying FROM a JOIN r ON a.entity = r.entity AND a.start = r.start WHERE a.trigger_at IS NOT NULL GROUP BY 1, 2, 3")
def trigger_proof(tb):
    """For each persistent alarm: the run's start, and that one qualifying sample stands up to its trigger."""
    r = series.with_runs(hourly(tb), "v > 60").where("cond")
    lasting = F.col("t") - F.col("run_start") > 2 * H
    trig = F.min(F.when(lasting, F.col("t"))).over(W.partitionBy("entity", "run_start"))
    x = r.withColumn("trigger_at", trig).where("trigger_at IS NOT NULL AND t <= trigger_at")
    return x.groupBy("entity", F.col("run_start").alias("start"), "trigger_at").agg(F.count("*").alias("samples_before"), F.count_if(lasting).alias("qualifying"))


def flagship(tb: Tables) -> DataFrame:
    """Incidents on the six-hour grid: values above 60 for more than six hours, sessions of a day."""
    s = series.with_segments(series.grid(tb.events, 6 * H), 6 * H)
    a = series.persistent(series.with_runs(s, "v > 60"), F.lit(6 * H)).withColumns({"kind": F.lit("kg_threshold_warning"), "rule_id": F.lit("W60")})
    a = a.withColumn("alarm_id", F.concat_ws("-", "entity", F.col("trigger_at").cast("string")))
    return links.incidents(links.sessions(a, 24 * H, tie=("alarm_id",))).select("entity", "session", "start", "end", "onset_estimate", "alarms", "severity")
