"""Evidence paths from incident to source with the place where one breaks, the contract that valid
records pass and faulty ones don't, rules read from lines as they stand, and events as incidents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import stateful
from . import detection as D
from .detection import H
from .proofs import decision_grounding
from .registry import ORACLES, query

#: Fixed codes of where a path breaks, by step, and the words for them; others have the default.
BREAKS = {
    "alarm": ("alarm_not_in_incident", "the alarm is none of this incident's"),
    "observation": ("observation_reference_mismatch", "no checked observation stands behind the alarm"),
    "rule": ("IR_rule_binding_mismatch", "alarm, executed rule and stored rule don't bind"),
    "source": ("source_document_missing_or_wrong", "the rule's document can't be found"),
}
DEFAULT = "a step doesn't begin where the one before it ends"

_STEP = f"(trigger_at // {H}) % 9"


@query(
    f"WITH {D.SESSIONS_SQL}, st AS (SELECT alarm_id, CASE {_STEP} WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 3 ELSE 0 END AS broken, {_STEP} = 4 AS apart FROM se)"
    " SELECT alarm_id, CASE WHEN broken = 0 THEN 4 ELSE broken - 1 END AS steps, CASE WHEN apart THEN 'path_not_contiguous' WHEN broken = 1 THEN 'alarm_not_in_incident' WHEN broken = 2 THEN 'observation_reference_mismatch' WHEN broken = 3 THEN 'IR_rule_binding_mismatch' WHEN broken = 4 THEN 'source_document_missing_or_wrong' ELSE '' END AS code,"
    f" CASE WHEN apart THEN '{DEFAULT.replace(chr(39), chr(39) * 2)}' " + " ".join(f"WHEN broken = {i} THEN '{w.replace(chr(39), chr(39) * 2)}'" for i, (_, w) in enumerate(BREAKS.values(), 1)) + " ELSE '' END AS message FROM st"
)
def evidence_paths(tb):
    """Each alarm's path incident, alarm, observation, rule, source as rows of steps: how many hold in
    order, and the code of the first that is missing or doesn't begin where the last ended."""
    s = D.sessioned(tb).withColumn("incident", F.concat_ws("#", "entity", F.col("session").cast("string")))
    k = F.floor(F.col("trigger_at") / H) % 9
    at, bound, document = F.concat_ws("@", "entity", "trigger_at"), F.concat_ws("/", "rule_id", "entity"), F.concat(F.lit("doc:"), F.col("kind"))
    steps = [("alarm", F.col("incident"), F.col("alarm_id"), k == 0), ("observation", F.col("alarm_id"), at, k == 1), ("rule", F.when(k == 4, F.lit("elsewhere")).otherwise(at), bound, k == 2), ("source", bound, document, k == 3)]
    rows = F.array(*[F.when(~gone, F.struct(F.lit(i).alias("i"), a.alias("from"), b.alias("to"))) for i, (_, a, b, gone) in enumerate(steps)])
    x = s.select("alarm_id", F.col("incident").alias("root"), F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("alarm_id", "root", "r.*")
    w = W.partitionBy("alarm_id").orderBy("i")
    placed = x.withColumn("there", F.coalesce(F.lag("to").over(w), F.col("root")) == F.col("from")).withColumn("next", F.lag("i", 1, -1).over(w) + 1 == F.col("i"))
    # the first step that is missing, or that begins elsewhere
    first = placed.groupBy("alarm_id").agg(F.min(F.when(F.col("next") & ~F.col("there"), F.col("i"))).alias("apart"), F.array_sort(F.collect_set("i")).alias("have"))
    gone = F.array_min(F.array_except(F.array(*[F.lit(i) for i in range(len(steps))]), "have"))
    broken = F.least("apart", "gone")
    names = [BREAKS[n] for n, *_ in steps]
    code, message = F.lit(""), F.lit("")
    for i, (c, text) in enumerate(names):
        code, message = F.when(F.col("broken") == i, c).otherwise(code), F.when(F.col("broken") == i, text).otherwise(message)
    out = s.select("alarm_id").join(first, "alarm_id", "left").withColumn("gone", F.when(F.col("have").isNull(), 0).otherwise(gone)).withColumn("broken", broken)
    apart = F.col("apart").isNotNull() & (F.col("apart") == F.col("broken")) & ~F.coalesce(F.col("gone") == F.col("broken"), F.lit(False))
    return out.select("alarm_id", F.coalesce("broken", F.lit(len(steps))).cast("long").alias("steps"), F.when(apart, "path_not_contiguous").otherwise(code).alias("code"), F.when(apart, DEFAULT).otherwise(message).alias("message"))


_FAULTS = ("value_differs", "start_differs", "units_disagree", "parameters_differ", "source_missing", "source_altered", "rule_differs", "source_repeated")


@query(f"WITH g AS ({ORACLES['decision_grounding']}) SELECT CASE WHEN issues = '' THEN 'valid' ELSE string_split(issues, ',')[1] END AS fault, count(*) AS n, count(*) FILTER (issues <> '') AS blocked FROM g GROUP BY 1")
def fault_contract(tb):
    """Injected faults by kind, and how many the checks block: all of them, and none of the valid ones."""
    g = decision_grounding(tb)
    fault = F.when(F.col("issues") == "", "valid").otherwise(F.split("issues", ",")[0])
    return g.groupBy(fault.alias("fault")).agg(F.count("*").alias("n"), F.count_if(F.col("issues") != "").alias("blocked"))


@query(
    "WITH u AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'RULE-' || p_partkey || ': size above ' || p_size WHEN p_partkey % 3 = 1 THEN 'RULE-' || p_partkey || ': size above ' || p_size || ' — check ' || p_brand ELSE p_brand || ' ' || p_name END AS text, p_partkey % 3 = 2 AS listed FROM part)"
    " SELECT id, CASE WHEN listed THEN 'AccessRule' ELSE 'OperationalRule' END AS rule_class, CASE WHEN listed THEN '' ELSE 'RULE-' || id END AS rule_id, CASE WHEN listed THEN text ELSE trim(string_split(substr(text, strpos(text, ':') + 1), ' — ')[1]) END AS condition_text, CASE WHEN listed THEN '' ELSE coalesce(trim(string_split(substr(text, strpos(text, ':') + 1), ' — ')[2]), '') END AS response_text, id % 40 <> 7 AS valid FROM u"
)
def literal_rules(tb):
    """Rules read from lines by their shape, 'id: condition — response' or a bare row, as they stand, and
    whether each quotes its own line; one in forty quotes another's."""
    k = F.col("p_partkey")
    size = F.concat(F.lit("RULE-"), k.cast("string"), F.lit(": size above "), F.col("p_size").cast("string"))
    text = F.when(k % 3 == 0, size).when(k % 3 == 1, F.concat(size, F.lit(" — check "), F.col("p_brand"))).otherwise(F.concat_ws(" ", "p_brand", "p_name"))
    u = tb.part.select(k.alias("id"), text.alias("text"), F.when(k % 40 == 7, F.lit("another line")).otherwise(text).alias("quote"))
    named = F.regexp_extract("text", r"^(RULE-\d+):", 1)
    body = F.split(F.regexp_replace("text", r"^RULE-\d+:", ""), " — ")
    rule = named != ""
    return u.select(
        "id", F.when(rule, "OperationalRule").otherwise("AccessRule").alias("rule_class"), named.alias("rule_id"),
        F.when(rule, F.trim(body[0])).otherwise(F.col("text")).alias("condition_text"), F.when(rule, F.coalesce(F.trim(F.get(body, 1)), F.lit(""))).otherwise("").alias("response_text"),
        F.contains("text", F.col("quote")).alias("valid"),
    )


@query()
def event_incidents(tb):
    """Every event of the scanner as one incident of its own: not regrouped, not typed, ids by content."""
    from .stateful import RULE_SCHEMA, RULES

    from ..operators import series

    e = stateful.scan(series.grid(tb.events, H), tb.rows(RULES, RULE_SCHEMA), H)
    own = F.sha2(F.concat_ws("|", "entity", "rule_id", F.col("trigger_at").cast("string")).cast("binary"), 256)
    return e.select(F.concat(F.lit("det-"), F.substring(own, 1, 20)).alias("incident_id"), "entity", F.col("trigger_at").alias("start"), F.coalesce("closed_at", "last_positive_at").alias("end"), F.array("rule_id").alias("rule_ids"), F.lit("UNCLASSIFIED").alias("anomaly_type"), "status")
