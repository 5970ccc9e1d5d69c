"""Checks of decisions, claims and graphs, and the packaging of evidence."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..operators import graph as G
from ..operators import links, rules, series
from ..operators import retrieval as R
from ..sources import tables
from . import detection as D
from .graphs import TRIPLES_SQL, triples
from .registry import query
from .retrieval import BM25_SQL, bm25_scores

H = D.H


@query(f"WITH {D.LIMITS_SQL} SELECT 'W-' || entity AS rule, entity AS sensor, CAST(nominal AS VARCHAR) AS nominal FROM lim")
def rule_nominals(tb):
    """Rule to sensor and sensor to threshold: a two-hop join of triples."""
    lim = D.limits(tb)
    t = G.union(
        G.triples_of(lim, F.concat(F.lit("W-"), "entity"), {"appliesToSensor": F.col("entity"), "type": F.lit("OperationalRule")}),
        G.triples_of(lim, F.concat(F.lit("T-"), "entity"), {"boundsSensor": F.col("entity"), "nominal": F.col("nominal")}),
    )
    rule = t.where("p = 'appliesToSensor'").select(F.col("s").alias("rule"), F.col("o").alias("sensor"))
    bound = t.where("p = 'boundsSensor'").select(F.col("s").alias("th"), F.col("o").alias("sensor"))
    nominal = t.where("p = 'nominal'").select(F.col("s").alias("th"), F.col("o").alias("nominal"))
    return rule.join(bound, "sensor").join(nominal, "th").select("rule", "sensor", "nominal")


@query(f"WITH {D.ALARMS_SQL}, ir(rule_id, entity) AS (SELECT r, entity FROM lim, (VALUES ('WARN'), ('CRIT'), ('OOR')) x(r) UNION ALL SELECT 'OOR', 'click') SELECT alarm_id, (SELECT count(*) FROM ir WHERE ir.rule_id = al.rule_id AND ir.entity = al.entity) AS bindings FROM al WHERE (SELECT count(*) FROM ir WHERE ir.rule_id = al.rule_id AND ir.entity = al.entity) <> 1")
def rule_binding_breaks(tb):
    """Alarms that don't bind to exactly one compiled rule. The rule table here lacks one and repeats one."""
    lim = D.limits(tb).select("entity")
    ir = lim.crossJoin(F.broadcast(tb.rows([("WARN",), ("CRIT",), ("OOR",)], "rule_id string"))).select("rule_id", "entity").unionByName(tb.rows([("OOR", "click")], "rule_id string, entity string"))
    n = ir.groupBy("rule_id", "entity").agg(F.count("*").alias("n"))
    return D.alarms(tb).join(F.broadcast(n), ["rule_id", "entity"], "left").select("alarm_id", F.coalesce("n", F.lit(0)).cast("long").alias("bindings")).where("bindings <> 1")


@query("SELECT event_id, c_custkey, n_name, r_name FROM events JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE event_type = 'error' AND value > 200")
def event_context_chain(tb):
    """From an event over its sensor to station and zone: chained joins from the filtered events."""
    e = tb.events.where("event_type = 'error' AND value > 200").select("event_id", "user_id")
    return e.join(tb.customer, F.col("c_custkey") == F.col("user_id")).join(tb.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(tb.region, F.col("r_regionkey") == F.col("n_regionkey")).select("event_id", "c_custkey", "n_name", "r_name")


_QUALITY = [("R1", "t > 26 (WARNING)", 26.0), ("R2", "drift somewhere", None), ("R3", None, None), ("R4", "is above 4 (CRITICAL)", 4.0), ("R5", "no number at all", None)]


@query("SELECT * FROM (VALUES (5::BIGINT, 1::BIGINT, 3::BIGINT, 2::BIGINT, 'CRITICAL,WARNING')) x(rules, missing_condition, missing_severity, executed, tags)")
def kg_quality_report(tb):
    df = rules.compile_conditions(tb.rows([(a, b) for a, b, _ in _QUALITY], "rule_id string, condition_text string")).withColumn("tag", rules.severity_tag(F.col("condition_text")))
    return df.agg(F.count("*").alias("rules"), F.count_if(F.col("condition_text").isNull()).alias("missing_condition"), F.count_if(F.col("tag").isNull()).alias("missing_severity"), F.count_if(F.col("op").isNotNull()).alias("executed"), F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))


@query("WITH g AS (SELECT doc_id, quality = 1 AS gold FROM labels), p AS (SELECT doc_id, length(text) AS n FROM documents), x AS (SELECT k, gold, n > k AS guess FROM g JOIN p USING (doc_id), (VALUES (500), (1000), (2000)) t(k)) SELECT k, count(*) FILTER (gold AND guess) AS tp, count(*) FILTER (NOT gold AND guess) AS fp, count(*) FILTER (gold AND NOT guess) AS fn, round(count(*) FILTER (gold AND guess) / count(*) FILTER (guess), 6) AS precision FROM x GROUP BY k")
def threshold_sensitivity(tb):
    """One pass scores all thresholds: each row is exploded to them, not joined again for each."""
    x = tb.documents.select("doc_id", F.length("text").alias("n")).join(tb.labels.select("doc_id", (F.col("quality") == 1).alias("gold")), "doc_id").select("n", "gold", F.explode(F.array(F.lit(500), F.lit(1000), F.lit(2000))).alias("k"))
    g = F.col("n") > F.col("k")
    return x.groupBy("k").agg(F.count_if(F.col("gold") & g).alias("tp"), F.count_if(~F.col("gold") & g).alias("fp"), F.count_if(F.col("gold") & ~g).alias("fn"), F.round(F.count_if(F.col("gold") & g) / F.count_if(g), 6).alias("precision"))


@query(f"WITH {D.grid_sql(H)}, {D.seg_sql(H)}, f AS (SELECT *, {D._STD} AS sd FROM s), {D.run_sql('sd < 20', 'f')}, a AS (SELECT entity, start, min(t) AS trigger_at FROM r GROUP BY entity, start) SELECT a.entity, trigger_at, round(f.sd, 6) AS feature, round(20 - f.sd, 6) > 0 AS proven, f.pos >= 4 AS full_window FROM a JOIN f ON f.entity = a.entity AND f.t = trigger_at")
def window_proof(tb):
    """Features at the triggers, recomputed from the samples alone."""
    base = series.rolling_std(D.hourly(tb), 4)
    a = series.counted_runs(series.with_runs(base, "std < 20"), 1, H).select("entity", "trigger_at")
    again = base.select("entity", F.col("t").alias("trigger_at"), "std", "pos")
    return a.join(again, ["entity", "trigger_at"]).select("entity", "trigger_at", F.round("std", 6).alias("feature"), (F.round(20 - F.col("std"), 6) > 0).alias("proven"), (F.col("pos") >= 4).alias("full_window"))


@query("WITH l AS (SELECT doc_id, unnest(list_transform(range(1, len(string_split(text, chr(10))) + 1), lambda i: {'i': i, 'l': string_split(text, chr(10))[i]})) AS x FROM documents WHERE doc_id < 200), g AS (SELECT doc_id, x.i AS i, x.l AS l, sum(CASE WHEN length(x.l) > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY x.i) AS block FROM l) SELECT doc_id, block::BIGINT AS block, count(*) AS lines, sum(length(l))::BIGINT AS chars FROM g GROUP BY doc_id, block")
def line_blocks(tb):
    """Lines grouped into blocks that a start line opens (here a line of more than 300 characters)."""
    x = tb.documents.where("doc_id < 200").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l"))
    b = F.sum((F.length("l") > 300).cast("long")).over(W.partitionBy("doc_id").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    return x.withColumn("block", b).groupBy("doc_id", "block").agg(F.count("*").alias("lines"), F.sum(F.length("l")).alias("chars"))


@query("WITH l AS (SELECT doc_id, unnest(list_transform(range(1, len(string_split(text, chr(10))) + 1), lambda i: {'i': i, 'l': string_split(text, chr(10))[i]})) AS x FROM documents), g AS (SELECT doc_id, x.i AS i, x.l AS l, sum(CASE WHEN length(x.l) > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY x.i) AS block FROM l) SELECT doc_id, block::BIGINT AS block, count(*) AS lines, sum(length(l))::BIGINT AS chars FROM g GROUP BY doc_id, block")
def line_blocks_all(tb):
    """line_blocks of every document."""
    x = tb.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l"))
    b = F.sum((F.length("l") > 300).cast("long")).over(W.partitionBy("doc_id").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    return x.withColumn("block", b).groupBy("doc_id", "block").agg(F.count("*").alias("lines"), F.sum(F.length("l")).alias("chars"))


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id LIMIT 50")
def recent_listing(tb):
    return tb.events.orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "user_id")


@query(f"WITH {TRIPLES_SQL}, m AS (SELECT s, p, o FROM tr UNION ALL VALUES ('C1', 'segment', 'NEW'), ('X9', 'segment', 'ODD')), v AS (SELECT s AS node, o AS detail FROM m WHERE p = 'segment' AND o NOT IN ('BUILDING', 'MACHINERY')), b AS (SELECT s, o FROM tr WHERE p = 'segment' AND o NOT IN ('BUILDING', 'MACHINERY')) SELECT * FROM v EXCEPT SELECT * FROM b")
def new_violations(tb):
    """Violations that a merged graph has beyond the base."""
    base = triples(tb)
    merged = base.unionByName(tb.rows([("C1", "segment", "NEW"), ("X9", "segment", "ODD")], "s string, p string, o string"))
    ok = ["BUILDING", "MACHINERY"]
    return G.one_of(merged, "segment", ok, "S").exceptAll(G.one_of(base, "segment", ok, "S")).select("node", "detail").distinct()


@query("WITH a AS (SELECT DISTINCT s_nationkey AS x FROM supplier), b AS (SELECT DISTINCT c_nationkey AS x FROM customer) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_b")
def set_equality(tb):
    p = G.set_algebra(tb.supplier.select("s_nationkey"), tb.customer.select("c_nationkey"))
    return p.agg(F.count_if(F.col("part") == "a_only").alias("only_a"), F.count_if(F.col("part") == "b_only").alias("only_b"))


_TYPED_SQL = f"{D.SESSIONS_SQL}, ty AS (SELECT entity || '#' || session AS id, entity, min(trigger_at) AS start, {D.TYPE_SQL} AS anomaly_type FROM se GROUP BY entity, session)"


def typed(tb):
    s = D.sessioned(tb)
    t = links.classify(s, spike_seconds=7200)
    i = s.groupBy("entity", "session").agg(F.min("trigger_at").alias("start"))
    return i.join(t, ["entity", "session"]).select(F.concat_ws("#", "entity", F.col("session").cast("string")).alias("id"), "entity", "start", "anomaly_type")


@query(f"WITH {_TYPED_SQL} SELECT id AS s, 'type' AS p, anomaly_type AS o FROM ty WHERE anomaly_type <> 'UNCLASSIFIED' UNION ALL SELECT id, 'observedAt', entity FROM ty WHERE anomaly_type <> 'UNCLASSIFIED' UNION ALL SELECT id, 'startedAt', CAST(start AS VARCHAR) FROM ty WHERE anomaly_type <> 'UNCLASSIFIED'")
def overlay_triples(tb):
    """Incidents as triples; those without a type stay out of the graph."""
    t = typed(tb).where("anomaly_type <> 'UNCLASSIFIED'")
    return G.triples_of(t, F.col("id"), {"type": F.col("anomaly_type"), "observedAt": F.col("entity"), "startedAt": F.col("start")})


@query("WITH e AS (SELECT o_orderkey AS id, o_custkey AS src, o_orderkey % 1700 AS dst FROM orders WHERE o_orderkey < 3000) SELECT id, 'self_loop' AS code FROM e WHERE src = dst UNION ALL SELECT id, 'unresolved' FROM e WHERE dst NOT IN (SELECT c_custkey FROM customer)")
def overlay_loader_checks(tb):
    e = tb.orders.where("o_orderkey < 3000").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 1700).alias("dst"))
    lost = e.join(tb.customer, F.col("dst") == F.col("c_custkey"), "left_anti").select("id", F.lit("unresolved").alias("code"))
    return e.where("src = dst").select("id", F.lit("self_loop").alias("code")).unionByName(lost)


@query("WITH e AS (SELECT o_orderkey AS id, o_custkey AS src, o_orderkey % 1700 AS dst FROM orders) SELECT id, 'self_loop' AS code FROM e WHERE src = dst UNION ALL SELECT id, 'unresolved' FROM e WHERE dst NOT IN (SELECT c_custkey FROM customer)")
def overlay_loader_checks_all(tb):
    """overlay_loader_checks over every order."""
    e = tb.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 1700).alias("dst"))
    lost = e.join(tb.customer, F.col("dst") == F.col("c_custkey"), "left_anti").select("id", F.lit("unresolved").alias("code"))
    return e.where("src = dst").select("id", F.lit("self_loop").alias("code")).unionByName(lost)


@query("WITH c(rel, a, b) AS (VALUES ('inNation', 'S1', 'N1'), ('inNation', 'N1', 'S1'), ('inRegion', 'N1', 'R1'), ('inRegion', 'N1', 'R99')) SELECT rel, a, b, CASE WHEN rel = 'inNation' AND a LIKE 'S%' AND b LIKE 'N%' THEN 'accepted' WHEN rel = 'inRegion' AND a LIKE 'N%' AND b LIKE 'R%' AND b <> 'R99' THEN 'accepted' ELSE 'rejected' END AS verdict FROM c")
def relation_candidates(tb):
    """Candidate relations whose ends exist with the types that the relation needs."""
    c = tb.rows([("inNation", "S1", "N1"), ("inNation", "N1", "S1"), ("inRegion", "N1", "R1"), ("inRegion", "N1", "R99")], "rel string, a string, b string")
    need = tb.rows([("inNation", "Supplier", "Nation"), ("inRegion", "Nation", "Region")], "rel string, ta string, tb string")
    kinds = triples(tb).where("p = 'type'").select(F.col("s"), F.col("o").alias("k"))
    j = c.join(need, "rel").join(kinds.select(F.col("s").alias("a"), F.col("k").alias("ka")), "a", "left").join(kinds.select(F.col("s").alias("b"), F.col("k").alias("kb")), "b", "left")
    return j.select("rel", "a", "b", F.when((F.col("ka") == F.col("ta")) & (F.col("kb") == F.col("tb")), "accepted").otherwise("rejected").alias("verdict"))


@query("WITH x AS (SELECT item_id, 'verify RULE-' || (item_id % 9) || ' and see RULE-' || (item_id % 4) || '; check RULE-' || (item_id % 3) AS t FROM benchmark) SELECT item_id, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '(?:verify|check) (RULE-[0-9]+)', 1))), ',') AS explicit, array_to_string(list_sort(list_distinct(regexp_extract_all(t, 'RULE-[0-9]+'))), ',') AS mentioned FROM x")
def explicit_references(tb):
    t = F.concat(F.lit("verify RULE-"), (F.col("item_id") % 9).cast("string"), F.lit(" and see RULE-"), (F.col("item_id") % 4).cast("string"), F.lit("; check RULE-"), (F.col("item_id") % 3).cast("string"))
    ids = lambda p, g: F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("t", F.lit(p), F.lit(g)))), ",")
    return tb.benchmark.select("item_id", t.alias("t")).select("item_id", ids("(?:verify|check) (RULE-[0-9]+)", 1).alias("explicit"), ids("RULE-[0-9]+", 0).alias("mentioned"))


@query(f"WITH {BM25_SQL}, x AS (SELECT query, doc, lang, row_number() OVER (PARTITION BY query, lang ORDER BY score DESC, doc) AS i FROM bm JOIN documents ON doc = doc_id) SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY i, lang) AS position FROM x QUALIFY row_number() OVER (PARTITION BY query ORDER BY i, lang) <= 8")
def shared_prefix(tb):
    """The first hit of every language, then the second of each, …: eight by query."""
    s = bm25_scores(tb).withColumn("score", F.round("score", 9)).join(tb.documents.select(F.col("doc_id").alias("doc"), "lang"), "doc")
    s = s.withColumn("i", F.row_number().over(W.partitionBy("query", "lang").orderBy(F.desc("score"), "doc"))).where("i <= 8")
    return R.round_robin(s, "lang", "i", ["query"]).where("position <= 8").select("query", "doc", F.col("position").cast("long").alias("position"))


_NAMES = [("en", "the", "DEF-ARTICLE"), ("fr", "les", "PLURAL-ARTICLE"), ("es", "para", "PURPOSE"), ("de", "und", "AND")]


@query("WITH n(alias, canonical) AS (VALUES ('the', 'DEF-ARTICLE'), ('les', 'PLURAL-ARTICLE'), ('para', 'PURPOSE'), ('und', 'AND')), h AS (SELECT item_id, string_agg(canonical, ' ' ORDER BY canonical) AS more FROM benchmark, n WHERE regexp_matches(' ' || text || ' ', '(?i)[^A-Za-z0-9_-]' || alias || '[^A-Za-z0-9_]') GROUP BY item_id) SELECT item_id, coalesce(more, '') AS expansion FROM benchmark LEFT JOIN h USING (item_id)")
def query_expansion(tb):
    """Canonical names of the aliases that a question mentions; the lexicon is small and broadcast."""
    n = tb.rows([(a, c) for _, a, c in _NAMES], "alias string, canonical string")
    h = tb.benchmark.join(F.broadcast(n), T.mentions(F.col("text"), F.col("alias"))).groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("canonical")), " ").alias("more"))
    return tb.benchmark.select("item_id").join(h, "item_id", "left").select("item_id", F.coalesce("more", F.lit("")).alias("expansion"))


@query("WITH x AS (SELECT item_id, 'Rule ID: MAINT-' || (item_id % 5) || '; Priority: ' || ['LOW', 'HIGH', 'CRITICAL'][item_id % 3 + 1] || '; Station: ST0' || (item_id % 4) || '; Sensor: TMP' AS t FROM benchmark) SELECT item_id, regexp_extract(t, 'Station:\\s*([^;\\n]+)', 1) || '_' || regexp_extract(t, 'Sensor:\\s*([^;\\n]+)', 1) AS sensor FROM x WHERE contains(t, 'Rule ID: MAINT-') AND contains(t, 'Priority: CRITICAL')")
def typed_rows(tb):
    i = F.col("item_id")
    t = F.concat(F.lit("Rule ID: MAINT-"), (i % 5).cast("string"), F.lit("; Priority: "), F.element_at(F.array(F.lit("LOW"), F.lit("HIGH"), F.lit("CRITICAL")), (i % 3 + 1).cast("int")), F.lit("; Station: ST0"), (i % 4).cast("string"), F.lit("; Sensor: TMP"))
    x = tb.benchmark.select("item_id", t.alias("t")).where(F.contains("t", F.lit("Rule ID: MAINT-")) & F.contains("t", F.lit("Priority: CRITICAL")))
    return x.select("item_id", F.concat_ws("_", F.regexp_extract("t", r"Station:\s*([^;\n]+)", 1), F.regexp_extract("t", r"Sensor:\s*([^;\n]+)", 1)).alias("sensor"))


_ROUTES = [("온도가 30 °C 이면 센서 규칙은?", "document"), ("현재 온도 조회해줘", "unavailable"), ("SOP-002 문서 설명", "document"), ("탐지 후보 규칙 문서", None), ("hello there", None), ("라인 꺼줘", "unavailable"), ("pressure 3.3 bar ok?", "document")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{q}', {repr(r) if r else 'NULL'}::VARCHAR)" for q, r in _ROUTES) + ") x(question, route)")
def question_routes(tb):
    return tb.rows([(q,) for q, _ in _ROUTES], "question string").select("question", rules.route(F.col("question")).alias("route"))


@query(f"WITH {D.SESSIONS_SQL} SELECT entity || '#' || session AS id, count(*) AS alarms, string_agg(rule_id || '@' || trigger_at, ',' ORDER BY trigger_at, rule_id) AS evidence FROM se GROUP BY entity, session")
def incident_packets(tb):
    g = D.sessioned(tb).groupBy("entity", "session").agg(F.count("*").alias("alarms"), F.array_sort(F.collect_list(F.struct("trigger_at", "rule_id"))).alias("xs"))
    return g.select(F.concat_ws("#", "entity", F.col("session").cast("string")).alias("id"), "alarms", F.array_join(F.transform("xs", lambda x: F.concat(x["rule_id"], F.lit("@"), x["trigger_at"].cast("string"))), ",").alias("evidence"))


@query(f"WITH {D.ALARMS_SQL}, x AS (SELECT al.alarm_id, list_filter([CASE WHEN g.v IS NULL THEN 'no_sample' END, CASE WHEN g.v <> trigger_value THEN 'value_differs' END, CASE WHEN run_start > trigger_at THEN 'starts_late' END, CASE WHEN last_positive_at - trigger_at < (positive_samples - 1) * {H} THEN 'too_many_samples' END, CASE WHEN kind = 'kg_threshold_critical' AND trigger_value <= crit THEN 'not_critical' END], lambda i: i IS NOT NULL) AS issues FROM al LEFT JOIN g ON g.entity = al.entity AND g.t = al.trigger_at JOIN lim ON lim.entity = al.entity) SELECT alarm_id, array_to_string(issues, ',') AS issues FROM x")
def decision_issues(tb):
    """What speaks against each alarm when it is checked against samples and limits; empty is good."""
    obs = series.grid(tb.events, H).select("entity", F.col("t").alias("trigger_at"), "v")
    j = D.alarms(tb).join(obs, ["entity", "trigger_at"], "left").join(F.broadcast(D.limits(tb)), "entity")
    checks = [("no_sample", F.col("v").isNull()), ("value_differs", F.col("v") != F.col("trigger_value")), ("starts_late", F.col("run_start") > F.col("trigger_at")), ("too_many_samples", F.col("last_positive_at") - F.col("trigger_at") < (F.col("positive_samples") - 1) * H), ("not_critical", (F.col("kind") == "kg_threshold_critical") & (F.col("trigger_value") <= F.col("crit")))]
    return j.select("alarm_id", F.array_join(F.array(*[F.when(c, n) for n, c in checks]), ",").alias("issues"))


@query(f"WITH {_TYPED_SQL}, c AS (SELECT id, 'type' AS claim, anomaly_type AS value FROM ty UNION ALL SELECT id, 'start', CAST(start AS VARCHAR) FROM ty), pick AS (SELECT id, claim, value FROM c WHERE claim = 'type' AND value IN ('SPIKE', 'STUCK')) SELECT c.id, c.claim, c.value, pick.id IS NOT NULL AS bound FROM c LEFT JOIN pick ON pick.id = c.id AND pick.claim = c.claim AND pick.value = c.value")
def claim_catalog(tb):
    """Claims that may be made of incidents, and which of them a selection binds."""
    c = G.triples_of(typed(tb), F.col("id"), {"type": F.col("anomaly_type"), "start": F.col("start")}).withColumnsRenamed({"s": "id", "p": "claim", "o": "value"})
    return c.withColumn("bound", (F.col("claim") == "type") & F.col("value").isin("SPIKE", "STUCK"))


@query("WITH m(ext, known) AS (VALUES ('click', 'W-click'), ('view', 'D-view')) SELECT event_type, coalesce(known, 'undocumented') AS rule, count(*) AS n FROM events LEFT JOIN m ON ext = event_type GROUP BY 1, 2")
def external_mapping(tb):
    m = tb.rows([("click", "W-click"), ("view", "D-view")], "event_type string, known string")
    return tb.events.join(F.broadcast(m), "event_type", "left").groupBy("event_type", F.coalesce("known", F.lit("undocumented")).alias("rule")).agg(F.count("*").alias("n"))


#: The reviewed conditions (rule, sensor, operation, value, second value, seconds).
REVIEWED = (
    ("RULE-ST01-01", "ST01_FILLING_FLW", "outside", "112", "128", 0),
    ("RULE-ST01-02", "ST01_FILLING_TMP", "gt", "26", None, 0),
    ("RULE-ST01-03", "ST01_FILLING_PRS", "lt", "3.3", None, 0),
    ("RULE-ST02-01", "ST02_SEALING_TMP", "outside", "175", "195", 0),
    ("RULE-ST02-02", "ST02_SEALING_TMP", "gt", "210", None, 0),
    ("RULE-ST02-03", "ST02_SEALING_CUR", "gt", "nominal+1.5", None, 300),
    ("RULE-ST03-01", "ST03_LABELLING_TEN", "outside", "1.8", "2.6", 0),
    ("RULE-ST03-02", "ST03_LABELLING_CNT", "lt", "110", None, 0),
    ("RULE-ST03-02", "ST03_LABELLING_CNT", "lt", "100", None, 0),
    ("RULE-ST03-03", "ST03_LABELLING_TEN", "stuck_exact", "11", None, 0),
    ("RULE-ST04-01", "ST04_PACKAGING_VIB", "gt", "0.20", None, 0),
    ("RULE-ST04-02", "ST04_PACKAGING_VIB", "gt", "0.35", None, 0),
    ("RULE-SRV01-01", "SRV01_SERVERROOM_TMP", "gt", "25", None, 0),
    ("RULE-SRV01-02", "SRV01_SERVERROOM_TMP", "gt", "28", None, 0),
    ("RULE-WRH01-01", "WRH01_WAREHOUSE_TMP", "outside", "0.5", "8", 0),
    ("RULE-WRH01-01", "WRH01_WAREHOUSE_TMP", "gt", "12", None, 0),
    ("RULE-WRH01-02", "WRH01_WAREHOUSE_HUM", "gt", "85", None, 0),
    ("RULE-CHM01-01", "CHM01_CHEMICALSTORAGE_TMP", "outside", "10", "20", 0),
    ("RULE-CHM01-01", "CHM01_CHEMICALSTORAGE_TMP", "gt", "25", None, 0),
    ("RULE-CHM01-02", "CHM01_CHEMICALSTORAGE_HUM", "gt", "50", None, 0),
    ("RULE-CHM01-02", "CHM01_CHEMICALSTORAGE_HUM", "gt", "45", None, 0),
    ("RULE-RND01-01", "RND01_RDLAB_TMP", "outside", "18", "26", 0),
    ("RULE-RND01-02", "RND01_RDLAB_HUM", "gt", "65", None, 0),
    ("RULE-RND01-02", "RND01_RDLAB_HUM", "gt", "75", None, 0),
    ("RULE-CAF01-01", "CAF01_CAFETERIA_TMP", "gt", "26", None, 0),
    ("RULE-CAF01-02", "CAF01_CAFETERIA_HUM", "gt", "70", None, 0),
    ("MAINT-03", "ST03_LABELLING_TEN", "stuck_exact", "11", None, 0),
    ("MAINT-04", "ST01_FILLING_PRS", "lt", "3.3", None, 900),
    ("MAINT-05", "SRV01_SERVERROOM_TMP", "gt", "25", None, 300),
    ("MAINT-07", "CHM01_CHEMICALSTORAGE_TMP", "gt", "20", None, 600),
)
_REVIEWED = "rule_id string, sensor_id string, op string, value string, second string, duration int"


@query("SELECT 9::BIGINT AS stations, 30::BIGINT AS rules, 2::BIGINT AS stuck, 6::BIGINT AS outside, 4::BIGINT AS lasting")
def reviewed_rules(tb):
    r = tb.rows(list(REVIEWED), _REVIEWED)
    return r.agg(F.count_distinct(T.station_of(F.col("sensor_id"))).alias("stations"), F.count("*").alias("rules"), F.count_if(F.col("op") == "stuck_exact").alias("stuck"), F.count_if(F.col("op") == "outside").alias("outside"), F.count_if(F.col("duration") > 0).alias("lasting"))


@query("SELECT 'reviewed' AS side, 'RULE-ST01-02' AS rule_id, '26' AS value UNION ALL SELECT 'compiled', 'RULE-ST01-02', '27'")
def rule_signature_diff(tb):
    """Signatures that only one of two rule tables has, with multiplicity; one value was changed here."""
    a = tb.rows(list(REVIEWED), _REVIEWED)
    b = a.withColumn("value", F.when(F.col("rule_id") == "RULE-ST01-02", "27").otherwise(F.col("value")))
    return a.exceptAll(b).select(F.lit("reviewed").alias("side"), "rule_id", "value").unionByName(b.exceptAll(a).select(F.lit("compiled").alias("side"), "rule_id", "value"))


@query("SELECT user_id, min(event_type) AS station FROM events WHERE value > 130 GROUP BY user_id HAVING count(DISTINCT event_type) = 1")
def sensors_with_one_station(tb):
    return tb.events.where("value > 130").groupBy("user_id").agg(F.min("event_type").alias("station"), F.count_distinct("event_type").alias("n")).where("n = 1").drop("n")


@query("WITH q AS (SELECT conv_id, turn, text || CASE WHEN conv_id % 2 = 0 THEN ' candidate-RULE-' || (conv_id % 3) ELSE '' END || ' RULE-' || (turn % 4) AS t FROM conversations), m AS (SELECT conv_id, turn, regexp_extract_all(t, 'candidate-RULE-[0-9]') AS c, regexp_extract_all(t, '\\bRULE-[0-9]') AS r FROM q) SELECT conv_id, turn, array_to_string(CASE WHEN len(c) > 0 THEN c ELSE r END, ',') AS ids FROM m".replace("\\\\", "\\"))
def exact_lookup(tb):
    """Identifiers that a text names; candidate ids, where there are any, take precedence."""
    t = F.concat("text", F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit(" candidate-RULE-"), (F.col("conv_id") % 3).cast("string"))).otherwise(""), F.lit(" RULE-"), (F.col("turn") % 4).cast("string"))
    c, r = F.regexp_extract_all(t, F.lit("candidate-RULE-[0-9]"), F.lit(0)), F.regexp_extract_all(t, F.lit(r"\bRULE-[0-9]"), F.lit(0))
    return tb.conversations.select("conv_id", "turn", F.array_join(F.when(F.size(c) > 0, c).otherwise(r), ",").alias("ids"))


@query(f"WITH {TRIPLES_SQL}, k AS (SELECT s, o AS kind, CASE o WHEN 'Supplier' THEN 0 WHEN 'Customer' THEN 1 WHEN 'Nation' THEN 2 ELSE 3 END AS pr FROM tr WHERE p = 'type') SELECT s, kind, row_number() OVER (ORDER BY pr, s) AS position FROM k QUALIFY row_number() OVER (ORDER BY pr, s) <= 30")
def seed_priority(tb):
    k = triples(tb).where("p = 'type'").select("s", F.col("o").alias("kind"), F.when(F.col("o") == "Supplier", 0).when(F.col("o") == "Customer", 1).when(F.col("o") == "Nation", 2).otherwise(3).alias("pr"))
    return k.orderBy("pr", "s").limit(30).select("s", "kind", F.row_number().over(W.orderBy("pr", "s")).cast("long").alias("position"))


@query("SELECT conv_id, count(*) AS units, string_agg(role || ':' || length(text), ';' ORDER BY turn) AS inventory FROM conversations GROUP BY conv_id")
def request_packets(tb):
    g = tb.conversations.groupBy("conv_id").agg(F.count("*").alias("units"), F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(":"), F.length("text").cast("string")).alias("x")))).alias("xs"))
    return g.select("conv_id", "units", F.array_join(F.transform("xs", lambda x: x["x"]), ";").alias("inventory"))


@query("SELECT event_id % 400 AS demo, count(DISTINCT user_id % 2) AS triggers FROM events WHERE value > 120 GROUP BY 1 HAVING count(DISTINCT user_id % 2) <> 1")
def demo_overlay_violations(tb):
    """Labelled events that don't have exactly one trigger."""
    return tb.events.where("value > 120").groupBy((F.col("event_id") % 400).alias("demo")).agg(F.count_distinct(F.col("user_id") % 2).alias("triggers")).where("triggers <> 1")


_ELIGIBLE = [("slope", None, None, 0, 600, 5), ("stuck_std", None, None, 0, None, 10), ("outside_run", None, None, 0, None, 40), (None, "stuck_exact", 11.0, 0, None, None), (None, "gt", 5.0, 7200, None, None), ("sustained_from_nominal", None, None, 0, 120, None)]


@query(f"WITH {D.grid_sql(H)}, {D.seg_sql(H)}, m AS (SELECT entity, max(pos) AS longest FROM s GROUP BY entity), n(i, need) AS (VALUES (0, 14), (1, 10), (2, 40), (3, 11), (4, 4), (5, 3)) SELECT entity, i, need, longest >= need AS eligible FROM m, n")
def rule_eligibility(tb):
    """Which rules each series has enough contiguous samples for."""
    r = tb.rows([(i, *x) for i, x in enumerate(_ELIGIBLE)], "i int, executor string, op string, value double, duration int, window_min int, readings int")
    need = rules.minimum_samples(F.col("executor"), F.col("op"), F.col("value"), F.col("duration"), F.col("window_min"), F.col("readings"), H, 2)
    m = series.longest_streak(D.hourly(tb)).select("entity", "longest")
    return m.crossJoin(F.broadcast(r.select("i", need.alias("need")))).select("entity", "i", "need", (F.col("longest") >= F.col("need")).alias("eligible"))


@query(f"WITH {D.grid_sql(H)}, b AS (SELECT max(a) AS lo, min(z) AS hi FROM (SELECT entity, min(t) AS a, max(t) AS z FROM g GROUP BY entity)) SELECT entity AS sensor_id, t, v FROM g, b WHERE t >= 1704844800 AND t < 1704844800 + 72000 AND lo <= 1704844800 AND hi >= 1704844800 + 72000")
def replay_slice(tb):
    return tables.replay_slice(series.grid(tb.events, H).select(F.col("entity").alias("sensor_id"), "t", "v"), 1_704_844_800, 1200)


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN NULL ELSE quality = 1 END AS coverage, CASE WHEN lang = 'en' THEN 'unknown' WHEN quality = 1 THEN 'complete' ELSE 'partial' END AS word FROM documents JOIN labels USING (doc_id)")
def coverage_states(tb):
    """Coverage with three states: null is unknown, not false."""
    c = F.when(F.col("lang") != "en", F.col("quality") == 1)
    return tb.documents.join(tb.labels, "doc_id").select("doc_id", c.alias("coverage"), F.when(c.isNull(), "unknown").when(c, "complete").otherwise("partial").alias("word"))


@query(f"WITH {D.grid_sql(H)}, a0 AS (SELECT *, CASE WHEN t < {D.CUT} THEN 'train' ELSE 'test' END AS part FROM g), a1 AS (SELECT *, CASE WHEN t - lag(t) OVER w = {H} AND part = lag(part) OVER w THEN 0 ELSE 1 END AS isgap FROM a0 WINDOW w AS (PARTITION BY entity ORDER BY t)), {D.run_sql('v > 60', 'a1')} SELECT entity, part, start AS run_start, min(t) AS trigger_at, count(*) AS positive_samples FROM r WHERE t - start > {2 * H} GROUP BY entity, part, start")
def split_reset_alarms(tb):
    """The first generation's rule: persistence starts anew where the split changes."""
    g = series.grid(tb.events, H).withColumn("part", F.when(F.col("t") < D.CUT, "train").otherwise("test"))
    s = series.with_segments(g, H, ("entity", "part"))
    return series.persistent(series.with_runs(s, "v > 60", ("entity", "part")), F.lit(2 * H), ("entity", "part")).select("entity", "part", "run_start", "trigger_at", "positive_samples")


@query(f"WITH {D.SESSIONS_SQL}, c AS (SELECT al.alarm_id, (SELECT min(t) FROM s WHERE s.entity = al.entity AND s.t > al.last_positive_at) - al.last_positive_at AS d FROM se al) SELECT se.entity || '#' || session AS id, count(*) FILTER (d IS NULL) AS open, count(*) FILTER (d > {H}) AS gap, count(*) FILTER (d = {H}) AS recovered FROM se JOIN c USING (alarm_id) GROUP BY se.entity, session")
def closure_report(tb):
    nxt = D.hourly(tb).select("entity", F.col("t").alias("last_positive_at"), (F.lead("t").over(W.partitionBy("entity").orderBy("t")) - F.col("t")).alias("d"))
    j = D.sessioned(tb).join(nxt, ["entity", "last_positive_at"], "left")
    return j.groupBy("entity", "session").agg(F.count_if(F.col("d").isNull()).alias("open"), F.count_if(F.col("d") > H).alias("gap"), F.count_if(F.col("d") == H).alias("recovered")).select(F.concat_ws("#", "entity", F.col("session").cast("string")).alias("id"), "open", "gap", "recovered")


@query("SELECT * FROM (VALUES ('Sensor: CUR; Rule: > 1.0 A over 30 min', 'CUR', 'over', 1800::BIGINT), ('Sensor: TMP; Rule: > 2 C for 2 h', 'TMP', 'for', 7200::BIGINT)) x(text, sensor, word, seconds)")
def delta_rule_rows(tb):
    """Table rows of delta rules: cells as a map, the window in seconds."""
    x = tb.rows([("Sensor: CUR; Rule: > 1.0 A over 30 min",), ("Sensor: TMP; Rule: > 2 C for 2 h",)], "text string")
    cells = F.str_to_map("text", F.lit(";\\s*"), F.lit(":\\s*"))
    rule = cells["Rule"]
    p = r"(over|for) ([0-9]+)\+? (min|h)"
    secs = F.regexp_extract(rule, p, 2).cast("long") * F.when(F.regexp_extract(rule, p, 3) == "h", 3600).otherwise(60)
    return x.select("text", cells["Sensor"].alias("sensor"), F.regexp_extract(rule, p, 1).alias("word"), secs.alias("seconds"))
