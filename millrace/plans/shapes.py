"""Shapes that a graph must have and leaks that an input graph must not, each as its violations, over
triples that the star tables give; the SQL reads the tables themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from .graphs import c
from .registry import Tables, query

#: Fixed codes of sensor types, kinds of evidence and subtypes of events.
SENSOR_TYPES = ["TMP", "PRS", "FLW", "CUR", "SPD", "TEN", "CNT", "VIB", "HUM"]
EVIDENCE = ["TimeseriesCorrelation", "SOPRule", "Both"]
SUBTYPES = ["Spike", "Drift", "StuckSensor", "OutOfRange", "Correlated"]
#: Fixed names that no property of an input graph may have.
FORBIDDEN = ["label", "anomalylabel", "severity", "alarmflag", "gtid", "gteventid", "isanomaly", "anomalytype", "rootcause", "causedby", "quality", "status", "alarms", "day", "shift", "batchid", "datasetseverity", "starttime", "endtime", "magnitude", "nominal", "warnhi", "warnlo", "crithi", "critlo"]


def _when(column: str, modulus: int, names: list[str]):
    out = F.lit(None).cast("string")
    for k, n in enumerate(names):
        out = F.when(F.col(column) % modulus == k, n).otherwise(out)
    return out


def shape_graph(tb: Tables) -> tuple[DataFrame, DataFrame]:
    """Triples, and stationed(s, p, o): sensors with the stations that have them. Suppliers are sensors
    with their sources, customers causal links, nations stations and rules, events anomalies."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    links = G.triples_of(
        tb.customer, c("C", "c_custkey"),
        {
            "type": F.lit("CausalLink"), "hasCause": F.when(k % 97 == 0, F.concat(F.lit("S"), k.cast("string"))).otherwise(c("N", "c_nationkey")), "hasEffect": F.concat(F.lit("N"), (k % 25).cast("string")),
            "hasEvidence": _when("c_custkey", 4, [*EVIDENCE, "Guess"]), "likelihoodScore": (F.col("c_acctbal").cast("double") / 10_000).cast("string"), "hasLag": (k % 50 - 2).cast("string"),
            "ruleIds": F.when(k % 3 == 0, F.concat(F.lit("RULE-"), (k % 30).cast("string"))), "windowId": F.when(k % 5 != 0, F.concat(F.lit("W"), (k % 11).cast("string"))),
        },
    )
    sensors = G.triples_of(
        tb.supplier, c("S", "s_suppkey"),
        {
            "type": F.lit("Sensor"), "sensorType": _when("s_suppkey", 10, [*SENSOR_TYPES, "XXX"]), "sourceKind": F.when(s % 2 == 0, "document").otherwise("seedCsv"), "page": F.when(s % 6 != 0, s.cast("string")),
            "textSha256": F.when(s % 11 == 0, F.upper(T.sha256(F.col("s_name")))).otherwise(T.sha256(F.col("s_name"))), "charStart": F.when(s % 4 != 0, F.lit("0")), "charEnd": F.when(s % 4 != 0, F.lit("9")), "tableId": F.when(s % 8 == 0, F.lit("T")), "rowIndex": F.when(s % 8 == 0, F.lit("1")), "colIndex": F.when(s % 8 == 0, F.lit("1")),
            "fileName": F.when(s % 7 != 0, F.lit("f.csv")), "sourceRowId": F.when(s % 9 != 0, s.cast("string")),
        },
    )
    n = F.col("n_nationkey")
    nations = G.triples_of(tb.nation, c("N", "n_nationkey"), {"type": F.lit("Station"), "ruleId": F.concat(F.lit("RULE-"), n.cast("string")), "isRule": F.lit("yes"), "sourceDocument": F.when(n % 7 != 0, F.lit("SOP"))})
    e = F.col("event_id")
    anomalies = G.triples_of(tb.events, c("E", "event_id"), {"type": F.when(e % 300 != 7, _when("event_id", 5, SUBTYPES))}).unionByName(G.triples_of(tb.events.where("event_id % 500 = 3"), c("E", "event_id"), {"type": _when("event_id", 3, SUBTYPES[:3])}))
    stationed = tb.supplier.where("s_suppkey % 41 <> 0").select(c("S", "s_suppkey").alias("s"), F.lit("hasSensor").alias("p"), c("N", "s_nationkey").alias("o"))
    second = tb.supplier.where("s_suppkey % 40 = 0").select(c("S", "s_suppkey").alias("s"), F.lit("hasSensor").alias("p"), F.concat(F.lit("N"), ((F.col("s_nationkey") + 1) % 25).cast("string")).alias("o"))
    return G.union(links, sensors, nations, anomalies), stationed.unionByName(second)


_SHAPES_SQL = " UNION ALL ".join([
    "SELECT 'S1' AS code, 'S' || s_suppkey AS node, CAST((s_suppkey % 41 <> 0)::INT + (s_suppkey % 40 = 0)::INT AS VARCHAR) AS detail FROM supplier WHERE (s_suppkey % 41 <> 0)::INT + (s_suppkey % 40 = 0)::INT <> 1",
    "SELECT 'S1', 'S' || s_suppkey, 'XXX' FROM supplier WHERE s_suppkey % 10 = 9",
    "SELECT 'S2', 'E' || event_id, CAST((event_id % 300 <> 7)::INT + (event_id % 500 = 3 AND (event_id % 300 = 7 OR event_id % 3 <> event_id % 5))::INT AS VARCHAR) FROM events WHERE (event_id % 300 <> 7)::INT + (event_id % 500 = 3 AND (event_id % 300 = 7 OR event_id % 3 <> event_id % 5))::INT <> 1",
    "SELECT 'S3', 'C' || c_custkey, 'N' || c_nationkey FROM customer WHERE c_custkey % 97 <> 0 AND c_nationkey = c_custkey % 25",
    "SELECT 'S3', 'C' || c_custkey, 'S' || c_custkey FROM customer WHERE c_custkey % 97 = 0",
    "SELECT 'S4', 'C' || c_custkey, 'Guess' FROM customer WHERE c_custkey % 4 = 3",
    "SELECT 'S5', 'C' || c_custkey, 'likelihoodScore' FROM customer WHERE c_acctbal < 0 OR c_acctbal > 10000",
    "SELECT 'S5', 'C' || c_custkey, 'hasLag' FROM customer WHERE c_custkey % 50 < 2",
    "SELECT 'S6', 'C' || c_custkey, 'ruleIds' FROM customer WHERE c_custkey % 4 IN (1, 2) AND c_custkey % 3 <> 0",
    "SELECT 'S6', 'C' || c_custkey, 'windowId' FROM customer WHERE c_custkey % 4 IN (0, 2) AND c_custkey % 5 = 0",
    "SELECT 'S6', 'C' || c_custkey, 'RULE-' || c_custkey % 30 FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 30 >= 25",
    "SELECT 'S7', 'S' || s_suppkey, upper(sha256(s_name)) FROM supplier WHERE s_suppkey % 11 = 0",
    "SELECT 'S7', 'S' || s_suppkey, 'charEnd+charStart+colIndex+page+rowIndex+tableId+textSha256' FROM supplier WHERE s_suppkey % 2 = 0 AND NOT (s_suppkey % 6 <> 0 AND (s_suppkey % 4 <> 0 OR s_suppkey % 8 = 0))",
    "SELECT 'S7', 'S' || s_suppkey, 'fileName+sourceRowId' FROM supplier WHERE s_suppkey % 2 = 1 AND (s_suppkey % 7 = 0 OR s_suppkey % 9 = 0)",
    "SELECT 'S8', 'N' || n_nationkey, 'sourceDocument' FROM nation WHERE n_nationkey % 7 = 0",
])


@query(_SHAPES_SQL)
def shape_guards(tb):
    """S1 to S8: cardinality, enumerations, one subtype, references, ranges, what evidence and sources need."""
    t, stationed = shape_graph(tb)
    of = lambda kind: t.where((F.col("p") == "type") & (F.col("o") == kind)).select("s").distinct()
    stations, rules = of("Station"), t.where("p = 'ruleId'").select(F.col("o").alias("s"))
    located = [["page", "textSha256", "charStart", "charEnd"], ["page", "textSha256", "tableId", "rowIndex", "colIndex"]]
    return G.union(
        G.exactly_one(stationed, of("Sensor"), "hasSensor", "S1"),
        G.one_of(t, "sensorType", SENSOR_TYPES, "S1"),
        G.one_subtype(t, tb.events.select(c("E", "event_id").alias("s")), SUBTYPES, "S2"),
        G.apart(t, "hasCause", "hasEffect", "S3"),
        G.refers_to(t, "hasCause", stations, "S3"),
        G.one_of(t, "hasEvidence", EVIDENCE, "S4"),
        G.in_range(t, "likelihoodScore", 0.0, 1.0, "S5"),
        G.in_range(t, "hasLag", 0.0, None, "S5"),
        G.required(t, "hasEvidence", ["SOPRule", "Both"], [["ruleIds"]], "S6"),
        G.required(t, "hasEvidence", ["TimeseriesCorrelation", "Both"], [["windowId"]], "S6"),
        G.refers_to(t, "ruleIds", rules, "S6"),
        G.of_type(t, "textSha256", "^[0-9a-f]{64}$", "S7"),
        G.required(t, "sourceKind", ["document"], located, "S7"),
        G.required(t, "sourceKind", ["seedCsv"], [["fileName", "sourceRowId"]], "S7"),
        G.required(t, "isRule", ["yes"], [["sourceDocument"]], "S8"),
    )


_NAMES = ["unit", "Warn_Hi", "zone", "root-cause", "im:quality", "identifier", "GT_id"]


@query(
    "WITH u AS (SELECT user_id, event_type, event_id FROM events) SELECT 'L1' AS code, 'E' || event_id AS node, 'type' AS detail FROM u WHERE event_id % 400 = 11 UNION ALL"
    " SELECT 'L2', 'E' || event_id, CASE event_id % 3 WHEN 0 THEN 'triggers' WHEN 1 THEN 'correlatesWith' ELSE 'causallyAffects' END FROM u WHERE event_id % 350 = 5 UNION ALL"
    f" SELECT 'L3', 'E' || event_id, [{', '.join(repr(n) for n in _NAMES)}][event_id % {len(_NAMES)} + 1] FROM u WHERE event_id % {len(_NAMES)} IN (1, 3, 4, 6) UNION ALL"
    " SELECT 'L4', 'E' || event_id, 'gt-' || lpad(CAST(user_id AS VARCHAR), 4, '0') FROM u WHERE event_id % 250 = 9 AND user_id < 10000"
)
def leak_guards(tb):
    """L1 to L4: anomalies, gold relations, forbidden names of properties and gold identifiers in an input graph."""
    e, k = tb.events, F.col("event_id")
    node = c("E", "event_id")
    named = F.lit(None).cast("string")
    for i, n in enumerate(_NAMES):
        named = F.when(k % len(_NAMES) == i, n).otherwise(named)
    t = G.union(
        G.triples_of(e, node, {"type": F.when(k % 400 == 11, "AnomalyEvent").otherwise("Reading"), "ref": F.when((k % 250 == 9) & (F.col("user_id") < 10_000), F.concat(F.lit("gt-"), F.lpad(F.col("user_id").cast("string"), 4, "0")))}),
        e.where("event_id % 350 = 5").select(node.alias("s"), _when("event_id", 3, ["triggers", "correlatesWith", "causallyAffects"]).alias("p"), F.lit("x").alias("o")),
        e.select(node.alias("s"), named.alias("p"), F.lit("1").alias("o")),
    )
    code = lambda rows, name, detail: rows.select(F.lit(name).alias("code"), F.col("s").alias("node"), detail.alias("detail"))
    return G.union(
        code(t.where("p = 'type' AND o IN ('AnomalyEvent', 'CausalLink')"), "L1", F.col("p")),
        code(t.where("p IN ('triggers', 'correlatesWith', 'causallyAffects')"), "L2", F.col("p")),
        G.forbidden_names(t, FORBIDDEN, "L3"),
        G.forbidden(t, None, "(?i)GT-[0-9]{4}", "L4"),
    )
