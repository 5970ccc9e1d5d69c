"""Graph, rule and verification queries: the star tables as triples, and tables of rule texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..operators import graph as G
from ..operators import rules
from .registry import Tables, query


def c(prefix: str, col: str):
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def triples(tb: Tables) -> DataFrame:
    """Regions, nations, suppliers and customers as triples."""
    return G.union(
        G.triples_of(tb.region, c("R", "r_regionkey"), {"type": F.lit("Region"), "label": F.col("r_name")}),
        G.triples_of(tb.nation, c("N", "n_nationkey"), {"type": F.lit("Nation"), "label": F.col("n_name"), "inRegion": c("R", "n_regionkey")}),
        G.triples_of(tb.supplier, c("S", "s_suppkey"), {"type": F.lit("Supplier"), "label": F.col("s_name"), "inNation": c("N", "s_nationkey")}),
        G.triples_of(tb.customer, c("C", "c_custkey"), {"type": F.lit("Customer"), "label": F.col("c_name"), "inNation": c("N", "c_nationkey"), "segment": F.col("c_mktsegment")}),
    )


_T = [
    ("region", "'R' || r_regionkey", {"type": "'Region'", "label": "r_name"}),
    ("nation", "'N' || n_nationkey", {"type": "'Nation'", "label": "n_name", "inRegion": "'R' || n_regionkey"}),
    ("supplier", "'S' || s_suppkey", {"type": "'Supplier'", "label": "s_name", "inNation": "'N' || s_nationkey"}),
    ("customer", "'C' || c_custkey", {"type": "'Customer'", "label": "c_name", "inNation": "'N' || c_nationkey", "segment": "c_mktsegment"}),
]
TRIPLES_SQL = "tr AS (" + " UNION ALL ".join(f"SELECT {s} AS s, '{p}' AS p, {o} AS o FROM {t}" for t, s, ps in _T for p, o in ps.items()) + ")"


@query(f"WITH {TRIPLES_SQL} SELECT s, p, o FROM tr")
def triples_from_star(tb):
    return triples(tb)


@query(f"WITH {TRIPLES_SQL} SELECT p, count(*) AS n, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects FROM tr GROUP BY p")
def relation_counts(tb):
    return triples(tb).groupBy("p").agg(F.count("*").alias("n"), F.count_distinct("s").alias("subjects"), F.count_distinct("o").alias("objects"))


@query(f"WITH {TRIPLES_SQL} SELECT s AS node FROM tr WHERE p = 'inNation' AND o = 'N3' UNION ALL SELECT o FROM tr WHERE s = 'N3' AND p = 'inRegion'")
def triple_lookup(tb):
    t = triples(tb)
    return t.where("p = 'inNation' AND o = 'N3'").select(F.col("s").alias("node")).unionByName(t.where("s = 'N3' AND p = 'inRegion'").select(F.col("o").alias("node")))


@query(f"WITH {TRIPLES_SQL}, l AS (SELECT s, p, list_sort(list(o)) AS os FROM tr GROUP BY s, p), x AS (SELECT s, string_agg('\"' || p || '\":[\"' || array_to_string(os, '\",\"') || '\"]', ',' ORDER BY p) AS body FROM l GROUP BY s) SELECT s, '{{' || body || '}}' AS node FROM x")
def node_serialisation(tb):
    return G.node_json(triples(tb))


@query(f"WITH {TRIPLES_SQL}, e AS (SELECT s AS a, o AS b FROM tr WHERE p IN ('inNation', 'inRegion') UNION SELECT o, s FROM tr WHERE p IN ('inNation', 'inRegion')), d1 AS (SELECT DISTINCT b AS node FROM e WHERE a = 'N3' AND b <> 'N3'), d2 AS (SELECT DISTINCT e.b AS node FROM e JOIN d1 ON e.a = d1.node WHERE e.b <> 'N3' AND e.b NOT IN (SELECT node FROM d1)) SELECT 'N3' AS node, 0 AS depth UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2")
def two_hop_bfs(tb):
    t = triples(tb)
    return G.bfs(G.neighbours(t, ["inNation", "inRegion"]), tb.rows([("N3",)], "node string"), 2)


_CHAIN = [(0, 5), (5, 9), (0, 9), (9, 12), (12, 3), (3, 0), (9, 3), (12, 20), (20, 21)]
_CHAIN_SQL = "e(a, b) AS (VALUES " + ", ".join(f"('N{a}', 'N{b}')" for a, b in _CHAIN) + ")"
_PATHS_SQL = f"{_CHAIN_SQL}, w AS (SELECT a, b, [a, b] AS path, 1 AS length FROM e UNION ALL SELECT w.a, e.b, list_append(path, e.b), length + 1 FROM w JOIN e ON e.a = w.b WHERE NOT list_contains(path, e.b) AND length < 8)"


def chain(tb: Tables) -> DataFrame:
    return tb.rows([(f"N{a}", f"N{b}") for a, b in _CHAIN], "a string, b string")


@query(f"WITH RECURSIVE {_PATHS_SQL} SELECT a, b, array_to_string(path, '>') AS path, length FROM w")
def simple_paths(tb):
    return G.simple_paths(tb.spark, chain(tb))


@query(f"WITH RECURSIVE {_PATHS_SQL} SELECT a, b, min(length) AS length, count(*) AS paths FROM w GROUP BY a, b")
def shortest_paths(tb):
    return G.simple_paths(tb.spark, chain(tb)).groupBy("a", "b").agg(F.min("length").alias("length"), F.count("*").alias("paths"))


@query(f"WITH {TRIPLES_SQL} SELECT DISTINCT a.s AS supplier, b.o AS region FROM tr a JOIN tr b ON a.o = b.s AND a.p = 'inNation' AND b.p = 'inRegion' WHERE a.s LIKE 'S%'")
def min_two_edge_paths(tb):
    t = triples(tb)
    a = t.where("p = 'inNation' AND s LIKE 'S%'").select(F.col("s").alias("supplier"), F.col("o").alias("nation"))
    return a.join(t.where("p = 'inRegion'").select(F.col("s").alias("nation"), F.col("o").alias("region")), "nation").select("supplier", "region").distinct()


@query("WITH a AS (SELECT DISTINCT l_suppkey AS x FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 49), b AS (SELECT DISTINCT l_suppkey AS x FROM lineitem WHERE l_discount >= 0.1 AND l_linestatus = 'O' AND l_quantity < 3) SELECT CASE WHEN a.x IS NOT NULL AND b.x IS NOT NULL THEN 'both' WHEN b.x IS NULL THEN 'a_only' ELSE 'b_only' END AS part, coalesce(a.x, b.x) AS x FROM a FULL JOIN b ON a.x = b.x")
def role_set_algebra(tb):
    li = tb.lineitem
    return G.set_algebra(li.where("l_returnflag = 'R' AND l_quantity >= 49").select("l_suppkey"), li.where("l_discount >= 0.1 AND l_linestatus = 'O' AND l_quantity < 3").select("l_suppkey"))


@query("SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'F') AND NOT bool_or(o_orderstatus <> 'F') THEN 'only' WHEN bool_or(o_orderstatus = 'F') THEN 'also_others' ELSE 'none' END AS part FROM orders GROUP BY o_custkey")
def target_partition(tb):
    return G.target_partition(tb.orders, "o_custkey", "o_orderstatus", F.col("o_orderstatus") == "F")


@query("SELECT n.n_nationkey FROM nation n WHERE (SELECT count(DISTINCT c_mktsegment) FROM customer WHERE c_nationkey = n.n_nationkey AND c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')) = 3")
def shared_by_all(tb):
    return G.shared_by_all(tb.customer.withColumnRenamed("c_nationkey", "n_nationkey"), "n_nationkey", "c_mktsegment", ["BUILDING", "MACHINERY", "HOUSEHOLD"])


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def missing_relation(tb):
    return tb.nation.join(tb.supplier, F.col("n_nationkey") == F.col("s_nationkey"), "left_anti").select("n_nationkey", "n_name")


@query("SELECT DISTINCT s_suppkey, n2.n_name AS other FROM supplier s JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation n2 ON n2.n_nationkey = c_nationkey WHERE c_nationkey <> s_nationkey AND l_quantity = 50 AND o_orderpriority LIKE '1%'")
def cross_station_rules(tb):
    """Suppliers with the other nations that their large urgent lines go to. The filtered fact side is
    joined first; the dimensions are small."""
    li = tb.lineitem.where("l_quantity = 50").select("l_orderkey", "l_suppkey")
    o = tb.orders.where("o_orderpriority LIKE '1%'").select("o_orderkey", "o_custkey")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(tb.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(tb.customer, F.col("o_custkey") == F.col("c_custkey"))
    return j.where("c_nationkey <> s_nationkey").join(tb.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("other")).distinct()


@query("SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_mktsegment = 'BUILDING' AND r_regionkey = 1 AND c_acctbal > 5000")
def filtered_kg_query(tb):
    """A complete query with all filters ANDed; filters reach the scans."""
    cu = tb.customer.where("c_mktsegment = 'BUILDING' AND c_acctbal > 5000")
    return cu.join(tb.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(tb.region.where("r_regionkey = 1"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "c_name", "n_name", "r_name")


_CARDS = "cd AS (SELECT 'a::' || p_brand AS s, 'type' AS p, min(p_type) AS o FROM part GROUP BY p_brand UNION ALL SELECT 'b::' || p_brand, 'type', max(p_type) FROM part GROUP BY p_brand UNION ALL SELECT 'b::' || p_brand, 'size', CAST(max(p_size) AS VARCHAR) FROM part GROUP BY p_brand)"


@query(f"WITH {_CARDS}, v AS (SELECT string_split(s, '::')[-1] AS id, p, o, list_sort(list(DISTINCT s)) AS srcs FROM cd GROUP BY 1, 2, 3) SELECT id, p, string_agg(o, '|' ORDER BY o) AS \"values\", array_to_string(list_sort(list_distinct(flatten(list(srcs)))), '|') AS sources, count(*) > 1 AS conflict FROM v GROUP BY id, p")
def merged_cards(tb):
    g = tb.part.groupBy("p_brand").agg(F.min("p_type").alias("lo"), F.max("p_type").alias("hi"), F.max("p_size").alias("sz"))
    t = G.union(G.triples_of(g, c("a::", "p_brand"), {"type": F.col("lo")}), G.triples_of(g, c("b::", "p_brand"), {"type": F.col("hi"), "size": F.col("sz")}))
    out = G.merged_cards(t, T.canonical_id(F.col("s")))
    return out.withColumn("sources", F.array_join(F.array_sort(F.split("sources", r"\|")), "|"))


@query("WITH x AS (SELECT 'S' || s_nationkey AS s, 'warnLo' AS p, min(s_acctbal) AS o FROM supplier GROUP BY 1 UNION ALL SELECT 'S' || s_nationkey, 'warnHi', max(s_acctbal) FROM supplier GROUP BY 1 UNION ALL SELECT 'S' || s_nationkey, 'nominal', min(s_acctbal) FROM supplier WHERE s_nationkey % 2 = 0 GROUP BY 1) SELECT s, max(o) FILTER (p = 'nominal') AS nominal, max(o) FILTER (p = 'warnLo') AS \"warnLo\", max(o) FILTER (p = 'warnHi') AS \"warnHi\" FROM x GROUP BY s")
def pivot_thresholds(tb):
    g = tb.supplier.groupBy("s_nationkey").agg(F.min("s_acctbal").alias("lo"), F.max("s_acctbal").alias("hi"))
    t = g.select(c("S", "s_nationkey").alias("s"), F.explode(F.array(F.struct(F.lit("warnLo").alias("p"), F.col("lo").alias("o")), F.struct(F.lit("warnHi").alias("p"), F.col("hi").alias("o")), F.struct(F.lit("nominal").alias("p"), F.when(F.col("s_nationkey") % 2 == 0, F.col("lo")).alias("o")))).alias("x")).select("s", "x.p", "x.o")
    return rules.wide_thresholds(t, ("nominal", "warnLo", "warnHi"))


@query("WITH w AS (SELECT s_nationkey, min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier GROUP BY 1), m AS (SELECT s_nationkey, min(s_acctbal) AS lo, max(s_acctbal) + (s_nationkey % 3) AS hi FROM supplier GROUP BY 1) SELECT s_nationkey, 'lo' AS field, w.lo AS kg, m.lo AS csv FROM w JOIN m USING (s_nationkey) WHERE w.lo <> m.lo UNION ALL SELECT s_nationkey, 'hi', w.hi, m.hi FROM w JOIN m USING (s_nationkey) WHERE w.hi <> m.hi")
def band_consistency(tb):
    """Fields in which two sources of the same bands differ; one shuffle for both."""
    w = tb.supplier.groupBy("s_nationkey").agg(F.min("s_acctbal").alias("lo"), F.max("s_acctbal").alias("hi"))
    long = w.select("s_nationkey", F.explode(F.array(F.struct(F.lit("lo").alias("field"), F.col("lo").alias("kg"), F.col("lo").alias("csv")), F.struct(F.lit("hi").alias("field"), F.col("hi").alias("kg"), (F.col("hi") + F.col("s_nationkey") % 3).alias("csv")))).alias("x"))
    return long.select("s_nationkey", "x.*").where("kg <> csv")


@query("SELECT p_brand, count(DISTINCT p_size) AS sizes, count(DISTINCT p_type) AS types FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) > 1")
def fd_check(tb):
    """Keys that don't determine a column."""
    return tb.part.groupBy("p_brand").agg(F.count_distinct("p_size").alias("sizes"), F.count_distinct("p_type").alias("types")).where("types > 1")


@query("SELECT count(*) AS n, count(*) - count(l_shipdate) AS missing_shipdate, count(*) FILTER (l_discount = 0) AS zero_discount, count(DISTINCT l_orderkey) AS orders, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicate_keys FROM lineitem")
def column_profile(tb):
    one = tb.lineitem.agg(F.count("*").alias("n"), (F.count("*") - F.count("l_shipdate")).alias("missing_shipdate"), F.count_if(F.col("l_discount") == 0).alias("zero_discount"), F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_orderkey", "l_linenumber").alias("_keys"))
    return one.withColumn("duplicate_keys", F.col("n") - F.col("_keys")).drop("_keys")


_SHAPES = [
    "SELECT 'S1' AS code, 'N' || n_nationkey AS node, CAST(count(DISTINCT s_suppkey) AS VARCHAR) AS detail FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey HAVING count(DISTINCT s_suppkey) <> 1",
    "SELECT 'S2', s, o FROM tr WHERE p = 'segment' AND o NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY')",
    "SELECT 'S3', s, o FROM tr WHERE p = 'label' AND NOT regexp_matches(o, '^(Supplier|Customer)#[0-9]{9}$')",
    "SELECT 'S4', s, o FROM tr WHERE p = 'inNation' AND o NOT IN (SELECT 'N' || n_nationkey FROM nation WHERE n_nationkey < 20)",
    "SELECT 'S5', s, 'segment' FROM tr WHERE p = 'type' AND o IN ('Customer', 'Supplier') AND s NOT IN (SELECT s FROM tr WHERE p = 'segment')",
]


@query(f"WITH {TRIPLES_SQL} " + " UNION ALL ".join(_SHAPES))
def shape_violations(tb):
    """Cardinality, enumeration, pattern, reference and conditional requirement, as violations."""
    t = triples(tb)
    inverse = tb.supplier.select(c("N", "s_nationkey").alias("s"), F.lit("hasSupplier").alias("p"), c("S", "s_suppkey").alias("o"))
    return G.union(
        G.exactly_one(inverse, tb.nation.select(c("N", "n_nationkey").alias("s")), "hasSupplier", "S1"),
        G.one_of(t, "segment", ["BUILDING", "AUTOMOBILE", "MACHINERY"], "S2"),
        G.of_type(t, "label", "^(Supplier|Customer)#[0-9]{9}$", "S3"),
        G.refers_to(t, "inNation", tb.nation.where("n_nationkey < 20").select(c("N", "n_nationkey").alias("s")), "S4"),
        G.required_if(t, "type", "Customer", "segment", "S5"),
        G.required_if(t, "type", "Supplier", "segment", "S5"),
    )


@query("SELECT 'L1' AS code, CAST(event_id AS VARCHAR) AS node, props AS detail FROM events WHERE regexp_matches(props, '\"k\": 1[0-9]}') UNION ALL SELECT 'L2', CAST(user_id AS VARCHAR), event_type FROM events WHERE regexp_matches('GT-' || lpad(CAST(user_id AS VARCHAR), 4, '0'), '(?i)gt-00[0-9]7')")
def leak_violations(tb):
    """Labels and gold identifiers that must not stand in the data."""
    e = tb.events
    t = G.union(e.select(F.col("event_id").cast("string").alias("s"), F.lit("props").alias("p"), F.col("props").alias("o")))
    ids = e.where(F.concat(F.lit("GT-"), F.lpad(F.col("user_id").cast("string"), 4, "0")).rlike("(?i)gt-00[0-9]7"))
    return G.forbidden(t, "props", '"k": 1[0-9]}', "L1").unionByName(ids.select(F.lit("L2").alias("code"), F.col("user_id").cast("string").alias("node"), F.col("event_type").alias("detail")))


@query("SELECT 'D1' AS code, CAST(s_suppkey AS VARCHAR) AS node FROM supplier INTERSECT SELECT 'D1', CAST(p_partkey AS VARCHAR) FROM part WHERE p_size > 25")
def disjoint_classes(tb):
    a, b = tb.supplier.select(F.col("s_suppkey").cast("string").alias("s")), tb.part.where("p_size > 25").select(F.col("p_partkey").cast("string").alias("s"))
    return G.disjoint(a, b, "D1").select("code", "node")


@query("WITH x AS (SELECT 'E' || (event_id % 50) AS s, event_type AS p, CAST(user_id % 5 AS VARCHAR) AS o, 'u' || (user_id % 7) AS evidence FROM events) SELECT s, p, o, array_to_string(list_sort(list(DISTINCT evidence)), ',') AS evidence FROM x GROUP BY s, p, o")
def evidence_ledger(tb):
    x = tb.events.select(F.concat(F.lit("E"), (F.col("event_id") % 50).cast("string")).alias("s"), F.col("event_type").alias("p"), (F.col("user_id") % 5).cast("string").alias("o"), F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("evidence"))
    return G.with_evidence(x).withColumn("evidence", F.array_join("evidence", ","))


@query("WITH x AS (SELECT doc_id, 'ref doc ' || (doc_id * 7 % 50) || ' and doc ' || (doc_id % 50) AS t FROM documents), e AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS src, unnest(regexp_extract_all(t, 'doc ([0-9]+)', 1)) AS dst FROM x), d1 AS (SELECT src, dst FROM e WHERE src <> dst), d2 AS (SELECT DISTINCT a.src, b.dst FROM d1 a JOIN d1 b ON a.dst = b.src WHERE a.src <> b.dst AND (a.src, b.dst) NOT IN (SELECT (src, dst) FROM d1)) SELECT src, dst, 1 AS hops FROM d1 UNION ALL SELECT src, dst, 2 FROM d2")
def rule_reference_edges(tb):
    x = tb.documents.select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("ref doc "), (F.col("doc_id") * 7 % 50).cast("string"), F.lit(" and doc "), (F.col("doc_id") % 50).cast("string")).alias("t"))
    e = G.references(x, "id", "t", r"doc ([0-9]+)").select("src", "dst")
    two = e.alias("a").join(e.alias("b"), F.col("a.dst") == F.col("b.src")).where("a.src <> b.dst").select("a.src", "b.dst").distinct().join(e, ["src", "dst"], "left_anti")
    return e.withColumn("hops", F.lit(1)).unionByName(two.withColumn("hops", F.lit(2)))


# Rule texts.

_TEXTS = [
    ("R1", "Temperature must not exceed 26 °C (WARNING)", "gt", 26.0, None, 0, False),
    ("R2", "Pressure drops below 3.3 bar sustained > 15 min (CRITICAL)", "lt", 3.3, None, 900, False),
    ("R3", "TMP must stay between 175 °C and 195 °C", "outside", 175.0, 195.0, 0, False),
    ("R4", "Current increases > 1.5 A above nominal for > 5 min", "gt", 1.5, None, 300, True),
    ("R5", "Value stuck for > 10 consecutive samples", "stuck_exact", 11.0, None, 0, False),
    ("R6", "HUM drifts above 65 %RH", "gt", 65.0, None, 0, False),
    ("R7", "Slow drift of the baseline", None, None, None, None, False),
    ("R8", "Flow drops below 80 L/min without an operator command", None, None, None, None, False),
    ("R9", "Vibration correlates with speed", None, None, None, None, False),
    ("R10", "COUNT < 100", "lt", 100.0, None, 0, False),
    ("R11", "SPD > 1.4", "gt", 1.4, None, 0, False),
    ("R12", "keep it clean", None, None, None, None, False),
]


def _lit(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


@query("SELECT * FROM (VALUES " + ", ".join(f"({_lit(r)}, {_lit(op)}::VARCHAR, {_lit(v)}::DOUBLE, {_lit(s)}::DOUBLE, {_lit(d)}::BIGINT, {rel}, {_lit('WARNING' if 'WARNING' in t else 'CRITICAL' if 'CRITICAL' in t else None)}::VARCHAR)" for r, t, op, v, s, d, rel in _TEXTS) + ") AS x(rule_id, op, value, second, duration_seconds, relative_to_nominal, tag)")
def compiled_conditions(tb):
    """Rule texts compiled; the oracle lists what reviewers expect."""
    df = tb.rows([(r, t) for r, t, *_ in _TEXTS], "rule_id string, condition_text string")
    return rules.compile_conditions(df).withColumn("tag", rules.severity_tag(F.col("condition_text"))).drop("condition_text", "unsupported")


@query("SELECT * FROM (VALUES ('drift >1.0 A over 30 min', 'window_change', 1.0, 30), ('drift >0.2 bar over 2 h', 'window_change', 0.2, 120), ('drift >1.0 A for 30+ min', 'sustained_from_nominal', 1.0, 30), ('temperature > 5', NULL, NULL, NULL)) AS x(rule, mode, delta, minutes)")
def maintenance_drift_rules(tb):
    df = tb.rows([("drift >1.0 A over 30 min",), ("drift >0.2 bar over 2 h",), ("drift >1.0 A for 30+ min",), ("temperature > 5",)], "rule string")
    out = df.select("rule", rules.maint_drift(F.col("rule")).alias("m")).select("rule", "m.*")
    return out.withColumn("delta", F.col("delta").cast("decimal(2,1)"))


@query("WITH r(rule_id, duration) AS (VALUES ('a', 0), ('b', 60), ('c', 75), ('d', 300)) SELECT rule_id, CASE WHEN duration = 0 THEN 0 ELSE (duration // 30 + 1) * 30 END::BIGINT AS first_trigger FROM r")
def rule_boundaries(tb):
    df = tb.rows([("a", 0), ("b", 60), ("c", 75), ("d", 300)], "rule_id string, duration long")
    return df.select("rule_id", rules.earliest_trigger(F.col("duration"), 30).alias("first_trigger"))


@query("WITH t(kind, k) AS (VALUES ('slope', 0.1), ('stuck_std', 0.001), ('outside_run', 20.0)), e AS (SELECT DISTINCT event_type FROM events) SELECT kind || '@' || event_type AS ir_id, event_type, kind, k::DOUBLE AS k FROM e, t")
def rules_per_entity(tb):
    defs = tb.rows([("slope", 0.1), ("stuck_std", 0.001), ("outside_run", 20.0)], "kind string, k double")
    return rules.per_entity(defs, tb.events.select("event_type").distinct()).select(F.concat_ws("@", "kind", "event_type").alias("ir_id"), "event_type", "kind", "k")


@query("WITH x AS (SELECT user_id % 4 AS cause, user_id % 3 AS effect, 'R' || (event_id % 6) AS rule_id FROM events WHERE user_id % 4 <> user_id % 3) SELECT cause, effect, array_to_string(list_sort(list(DISTINCT rule_id)), ',') AS rule_ids FROM x GROUP BY cause, effect")
def correlation_pair_merge(tb):
    x = tb.events.select((F.col("user_id") % 4).alias("cause"), (F.col("user_id") % 3).alias("effect"), F.concat(F.lit("R"), (F.col("event_id") % 6).cast("string")).alias("rule_id")).where("cause <> effect")
    return x.groupBy("cause", "effect").agg(F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rule_ids"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'validation' ELSE 'test' END AS part FROM documents")
def split_labels(tb):
    return tb.documents.select("doc_id", rules.split_label((F.col("doc_id") % 10).cast("string"), "7", "9").alias("part"))


# Verification.


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'price' ELSE 'status' END AS field FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0")
def joined_equality(tb):
    """Two copies of a table joined 1:1; every field that differs. Built here with known differences."""
    a = tb.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    b = a.select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("p"), F.when((F.col("o_orderkey") % 11 == 0) & (F.col("o_orderkey") % 7 != 0), F.lit("?")).otherwise(F.col("o_orderstatus")).alias("st"))
    j = a.join(b, "o_orderkey", "full")
    bad = F.filter(F.array(F.when(~F.col("o_totalprice").eqNullSafe(F.col("p")), "price"), F.when(~F.col("o_orderstatus").eqNullSafe(F.col("st")), "status")), lambda x: x.isNotNull())
    return j.select("o_orderkey", F.explode(bad).alias("field"))


@query("WITH p AS (SELECT o_orderkey AS path, l_linenumber AS step, l_suppkey AS a, lead(l_suppkey) OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_suppkey) AS nxt, l_partkey % 5 > 0 AS known FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey < 500) SELECT path, count(*) AS steps, bool_and(known) AS edges_known, count(*) FILTER (nxt < a) AS breaks FROM p GROUP BY path")
def evidence_path_check(tb):
    """Paths of steps: whether every step's edge is known, and where one step doesn't meet the next."""
    w = W.partitionBy("path").orderBy("step", "a")
    p = tb.lineitem.where("l_orderkey < 500").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("step"), F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 5 > 0).alias("known"))
    return p.withColumn("nxt", F.lead("a").over(w)).groupBy("path").agg(F.count("*").alias("steps"), F.bool_and("known").alias("edges_known"), F.count_if(F.col("nxt") < F.col("a")).alias("breaks"))


@query("WITH p AS (SELECT l_orderkey AS path, l_suppkey AS a, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS nxt, l_partkey % 5 > 0 AS known FROM lineitem) SELECT path, count(*) AS steps, bool_and(known) AS edges_known, count(*) FILTER (nxt < a) AS breaks FROM p GROUP BY path")
def evidence_path_check_all(tb):
    """evidence_path_check over every path."""
    w = W.partitionBy("path").orderBy("step", "a")
    p = tb.lineitem.select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("step"), F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 5 > 0).alias("known"))
    return p.withColumn("nxt", F.lead("a").over(w)).groupBy("path").agg(F.count("*").alias("steps"), F.bool_and("known").alias("edges_known"), F.count_if(F.col("nxt") < F.col("a")).alias("breaks"))


@query("SELECT doc_id, substring(text, 11, 30) = substring(text, 11, 30) AND sha256(substring(text, 11, 30)) <> sha256(substring(text, 12, 30)) AS span_ok FROM documents WHERE length(text) > 60")
def span_integrity(tb):
    """Claims that quote a span: the text at its offsets has the claim's hash, a shifted one doesn't."""
    d = tb.documents.where("length(text) > 60").select("doc_id", "text", T.sha256(F.substring("text", 11, 30)).alias("claim"))
    return d.select("doc_id", ((T.sha256(F.substring("text", 11, 30)) == F.col("claim")) & (T.sha256(F.substring("text", 12, 30)) != F.col("claim"))).alias("span_ok"))


@query("WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey < 2000), b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 97 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity FROM a) SELECT 'a' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'b', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def run_equivalence(tb):
    """Rows that only one of two runs has, with multiplicity."""
    a = tb.lineitem.where("l_orderkey < 2000").select("l_orderkey", "l_linenumber", "l_quantity")
    b = a.withColumn("l_quantity", F.when(F.col("l_orderkey") % 97 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    return a.exceptAll(b).select(F.lit("a").alias("side"), "*").unionByName(b.exceptAll(a).select(F.lit("b").alias("side"), "*"))


@query("WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem), b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 97 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity FROM a) SELECT 'a' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'b', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def run_equivalence_all(tb):
    """run_equivalence over every row."""
    a = tb.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    b = a.withColumn("l_quantity", F.when(F.col("l_orderkey") % 97 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    return a.exceptAll(b).select(F.lit("a").alias("side"), "*").unionByName(b.exceptAll(a).select(F.lit("b").alias("side"), "*"))


@query("SELECT l_returnflag AS part, count(*) AS n, sha256(string_agg(sha256(l_orderkey || '|' || l_linenumber), '' ORDER BY l_orderkey, l_linenumber)) AS seal FROM lineitem WHERE l_orderkey < 3000 GROUP BY l_returnflag")
def sealed_manifest(tb):
    """A hash of each part's row hashes in order of the key: any changed row changes it."""
    r = tb.lineitem.where("l_orderkey < 3000").select(F.col("l_returnflag").alias("part"), F.struct("l_orderkey", "l_linenumber").alias("k"), T.sha256(F.concat_ws("|", "l_orderkey", "l_linenumber")).alias("h"))
    return r.groupBy("part").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("k", "h"))).alias("xs")).select("part", "n", T.sha256(F.array_join(F.transform("xs", lambda x: x["h"]), "")).alias("seal"))


@query("WITH b AS (SELECT l_returnflag AS part, l_orderkey // 1000 AS block, count(*) AS n, sha256(string_agg(sha256(l_orderkey || '|' || l_linenumber), '' ORDER BY l_orderkey, l_linenumber)) AS seal FROM lineitem GROUP BY part, block) SELECT part, sum(n)::BIGINT AS n, sha256(string_agg(seal, '' ORDER BY block)) AS seal FROM b GROUP BY part")
def sealed_manifest_all(tb):
    """Every row sealed: a hash of the hashes of blocks of 1000 keys, so that no part meets in one row."""
    r = tb.lineitem.select(F.col("l_returnflag").alias("part"), F.floor(F.col("l_orderkey") / 1000).alias("block"), F.struct("l_orderkey", "l_linenumber").alias("k"), T.sha256(F.concat_ws("|", "l_orderkey", "l_linenumber")).alias("h"))
    b = r.groupBy("part", "block").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("k", "h"))).alias("xs")).select("part", "block", "n", T.sha256(F.array_join(F.transform("xs", lambda x: x["h"]), "")).alias("h"))
    return b.groupBy("part").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("block", "h"))).alias("xs")).select("part", "n", T.sha256(F.array_join(F.transform("xs", lambda x: x["h"]), "")).alias("seal"))


@query("WITH m AS (SELECT user_id, count(*) AS n, list_sort(list(DISTINCT event_type)) AS kinds FROM events GROUP BY user_id) SELECT user_id, n, array_to_string(kinds, ',') AS kinds, len(list_filter(['click', 'error'], lambda x: NOT list_contains(kinds, x))) = 0 AS coverage_complete FROM m")
def coverage_sets(tb):
    g = tb.events.groupBy("user_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("event_type")).alias("kinds"))
    return g.select("user_id", "n", F.array_join("kinds", ",").alias("kinds"), (F.size(F.array_except(F.array(F.lit("click"), F.lit("error")), "kinds")) == 0).alias("coverage_complete"))


@query("WITH e AS (SELECT s_suppkey AS a, s_nationkey AS b FROM supplier) SELECT a, b, CASE WHEN b IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0) THEN 'typed' WHEN b % 2 = 0 THEN 'excluded_even' ELSE 'excluded_odd' END AS disposition FROM e")
def edge_dispositions(tb):
    """Edges become typed relations or are excluded, and the audit says why."""
    ok = tb.nation.where("n_regionkey = 0").select("n_nationkey", F.lit(True).alias("ok"))
    j = tb.supplier.select(F.col("s_suppkey").alias("a"), F.col("s_nationkey").alias("b")).join(ok, F.col("b") == F.col("n_nationkey"), "left")
    return j.select("a", "b", F.when(F.col("ok"), "typed").when(F.col("b") % 2 == 0, "excluded_even").otherwise("excluded_odd").alias("disposition"))


@query("WITH x AS (SELECT conv_id, turn, role, text FROM conversations), n AS (SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS users, min(turn) AS first, max(turn) AS last FROM x GROUP BY conv_id) SELECT conv_id, turns, users, last - first + 1 = turns AS contiguous FROM n")
def conversation_packets(tb):
    return tb.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("users"), (F.max("turn") - F.min("turn") + 1 == F.count("*")).alias("contiguous"))


@query("SELECT doc_id, text_kind, agree FROM (SELECT doc_id, CASE WHEN n_chars = length(text) THEN 'same' ELSE 'differs' END AS text_kind, (quality = 1) = (toxic = 0) AS agree FROM documents JOIN labels USING (doc_id))")
def label_join(tb):
    return tb.documents.join(tb.labels, "doc_id").select("doc_id", F.when(F.col("n_chars") == F.length("text"), "same").otherwise("differs").alias("text_kind"), ((F.col("quality") == 1) == (F.col("toxic") == 0)).alias("agree"))
