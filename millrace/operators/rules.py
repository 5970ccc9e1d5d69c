"""Rules from text: ordered regular expressions turn a condition's wording into parameters.

The order matters: wordings that can't be executed are recognised first, a duration phrase is taken
out before the numbers are read. compile_conditions() is one projection; a rule table of any size
stays on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed wording of the rule texts: what a number looks like, and the phrases of each form.
NUMBER = r"(-?\d+(?:\.\d+)?)"
DURATION = r"(?:sustained|for) >\s*(\d+) min"
STUCK = r"stuck(?: for)? >\s*(\d+) (?:consecutive )?samples"
ABOVE_NOMINAL = r"increases? >\s*" + NUMBER + r" a above nominal"
BETWEEN = r"between " + NUMBER + r"\s*(?:°c|l/min|n|%rh)? and " + NUMBER
DRIFTS_ABOVE = r"drifts above " + NUMBER
GREATER = ("must not exceed ", "exceeds ", "is above ", "> ?")
LESS = ("drops below ", "is below ", "< ?")
UNSUPPORTED = (
    (r"without an operator command", "an operator's command is not in the data"),
    (r"triggers a warning|correlat|increases with", "monitors another sensor, compares nothing"),
    (r"drift(?!s above -?\d)", "drift without a number to compare"),
)


def compile_conditions(rules: DataFrame, text: str = "condition_text") -> DataFrame:
    """Adds op (gt, lt, outside, stuck_exact), value, second, duration_seconds, relative_to_nominal
    and unsupported (a reason, or null). Of the forms, the first that a text has decides."""
    whole = F.lower(F.trim(F.regexp_replace(F.col(text), r"\s+", " ")))
    df = rules.withColumn("_all", whole)
    minutes = F.regexp_extract("_all", DURATION, 1).try_cast("long")
    # only the first duration phrase goes; what stands after it is read as before
    at = F.regexp_instr("_all", F.lit(DURATION))
    phrase = F.regexp_extract("_all", DURATION, 0)
    rest = F.when(at > 0, F.concat(F.substring("_all", F.lit(1), at - 1), F.substring("_all", at + F.length(phrase), F.length("_all")))).otherwise(F.col("_all"))
    df = df.withColumn("_rest", rest)
    forms = [(STUCK, "stuck_exact"), (ABOVE_NOMINAL, "gt"), (BETWEEN, "outside"), (DRIFTS_ABOVE, "gt"), *((p + NUMBER, "gt") for p in GREATER), *((p + NUMBER, "lt") for p in LESS)]
    which = F.lit(None).cast("int")
    for k, (pattern, _) in reversed(list(enumerate(forms))):
        which = F.when(F.col("_rest").rlike(pattern), k).otherwise(which)
    reason = F.lit(None).cast("string")
    # the second drift test must hold for the text as a whole, not for one of its mentions
    tests = [(F.col("_all").rlike(UNSUPPORTED[0][0]), UNSUPPORTED[0][1]), (F.col("_all").rlike(UNSUPPORTED[1][0]), UNSUPPORTED[1][1]), (F.contains("_all", F.lit("drift")) & ~F.col("_all").rlike(DRIFTS_ABOVE), UNSUPPORTED[2][1])]
    for test, why in reversed(tests):
        reason = F.when(test, why).otherwise(reason)
    df = df.withColumn("_why", reason).withColumn("_k", F.when(F.col("_why").isNull(), which))

    def group(n: int) -> Column:
        out = F.lit(None).cast("string")
        for k, (pattern, _) in enumerate(forms):
            if n == 1 or pattern == BETWEEN:
                out = F.when(F.col("_k") == k, F.regexp_extract("_rest", pattern, n)).otherwise(out)
        return out.try_cast("double")

    op = F.lit(None).cast("string")
    for k, (_, name) in enumerate(forms):
        op = F.when(F.col("_k") == k, name).otherwise(op)
    stuck = F.col("_k") == 0
    return df.withColumns(
        {
            "op": op,
            "value": F.when(stuck, group(1) + 1).otherwise(group(1)),
            "second": group(2),
            "duration_seconds": F.when(F.col("_k").isNotNull(), F.when(stuck, 0).otherwise(F.coalesce(minutes * 60, F.lit(0)))).cast("long"),
            "relative_to_nominal": F.coalesce(F.col("_k") == 1, F.lit(False)),
            "unsupported": F.when(F.col("_k").isNull(), F.coalesce("_why", F.lit("no known form"))),
        }
    ).drop("_all", "_rest", "_why", "_k")


def maint_drift(text: Column) -> Column:
    """Struct of mode (window_change for 'drift >D over W', sustained_from_nominal for 'drift >D for
    W+ min', else null), delta and minutes."""
    low = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    over = r"drift >" + NUMBER + r"\s*[^\s\d]*\s+over (\d+) (min|h)\b"
    lasting = r"drift >" + NUMBER + r"\s*[^\s\d]*\s+for (\d+)\+ min"
    changes = low.rlike(over)
    return F.struct(
        F.when(changes, "window_change").when(low.rlike(lasting), "sustained_from_nominal").alias("mode"),
        F.when(changes, F.regexp_extract(low, over, 1)).otherwise(F.regexp_extract(low, lasting, 1)).try_cast("double").alias("delta"),
        F.when(changes, F.regexp_extract(low, over, 2).try_cast("int") * F.when(F.regexp_extract(low, over, 3) == "h", 60).otherwise(1)).otherwise(F.regexp_extract(low, lasting, 2).try_cast("int")).alias("minutes"),
    )


def partial_precondition(text: Column) -> Column:
    """The limit of 'drops below X unit without an operator command', else null."""
    return F.regexp_extract(F.lower(F.regexp_replace(text, r"\s+", " ")), "drops below " + NUMBER + r" \S+ without an operator command", 1).try_cast("double")


#: Fixed codes of measured quantities.
QUANTITIES = {"speed": "SPD", "current": "CUR", "temperature": "TMP", "humidity": "HUM", "pressure": "PRS", "vibration": "VIB", "tension": "TEN", "flow": "FLW", "count": "CNT"}


def correlation_effects(text: Column, cause_sensor: Column) -> Column:
    """Sensors of other stations that a correlation text names, in its order."""
    flat = F.regexp_replace(text, r"\s+", " ")
    pattern = r"\b([A-Z]{2,3}\d{2}_[A-Z]+) (\w+)"
    codes = F.create_map(*[F.lit(x) for kv in QUANTITIES.items() for x in kv])
    named = F.zip_with(F.regexp_extract_all(flat, F.lit(pattern), F.lit(1)), F.regexp_extract_all(flat, F.lit(pattern), F.lit(2)), lambda st, q: F.when(st != F.regexp_replace(cause_sensor, "_[^_]*$", ""), F.concat(st, F.lit("_"), F.element_at(codes, F.lower(q)))))
    return F.when(flat.rlike("(?i)correlat|increases with"), F.filter(named, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def severity_tag(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\((CRITICAL|WARNING)\)", 1), F.lit(""))


def effect_direction(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.rlike("reduction|decreas|drop"), "below_nominal").when(low.rlike("increas|rise|rising"), "above_nominal")


def type_parameters(text: Column) -> Column:
    """Struct of what the five anomaly-type definitions state: sigma_per_min, readings, window_min
    (DRIFT), window, nominal_fraction (STUCK), max_minutes (SPIKE), within_min (CORRELATED)."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))

    def num(pattern: str, kind: str, k: int = 1) -> Column:
        return F.regexp_extract(flat, pattern, k).try_cast(kind)

    slope, stuck = r"slope >" + NUMBER + r"σ/min for (\d+)\+ readings", r"std\(last (\d+)\)<" + NUMBER + "×nominal"
    return F.struct(
        num(slope, "double").alias("sigma_per_min"),
        F.coalesce(num(slope, "int", 2), num(r">WARN for (\d+)\+ readings", "int")).alias("readings"),
        num(r"deviation >(\d+) min", "int").alias("window_min"),
        num(stuck, "int").alias("window"),
        num(stuck, "double", 2).alias("nominal_fraction"),
        num(r"<(\d+) min", "int").alias("max_minutes"),
        num(r"within (\d+) min of cause", "int").alias("within_min"),
    )


def violates(op: Column, value: Column, lo: Column, hi: Column | None = None) -> Column:
    """Strict: a value on a limit violates nothing."""
    out = F.when(op == "gt", value > lo).when(op == "lt", value < lo)
    return out.when(op == "outside", (value < lo) | (value > hi)) if hi is not None else out


def wide_thresholds(triples: DataFrame, properties: tuple[str, ...]) -> DataFrame:
    """One row a subject with a column a property (its smallest value); properties are given, so no
    extra pass finds them."""
    return triples.where(F.col("p").isin(*properties)).groupBy("s").pivot("p", list(properties)).agg(F.min("o"))


def per_entity(definitions: DataFrame, entities: DataFrame) -> DataFrame:
    """Every definition for every entity; definitions are a handful of rows."""
    return entities.crossJoin(F.broadcast(definitions))


def minimum_samples(executor: Column, op: Column, value: Column, duration: Column, window_min: Column, readings: Column, step: int, smooth: int) -> Column:
    """Samples that a rule needs before it can fire. window_min: minutes of its window or of the
    deviation it needs; readings: its count, or the samples of its window."""
    span = (window_min * 60 / step).cast("int")
    lasting = F.when(duration > 0, F.floor(duration / step).cast("int") + 2).otherwise(1)
    return (
        F.when(op == "stuck_exact", value.cast("int") + lasting - 1)
        .when(executor == "slope", span + readings - 1)
        .when(executor.isin("stuck_std", "outside_run"), readings)
        .when(executor == "window_change", span + smooth)
        .when(executor == "sustained_from_nominal", span + 1)
        .otherwise(lasting)
    )


def earliest_trigger(duration: Column, step: int) -> Column:
    """Seconds from a run's first sample to the first that a strict duration lets fire."""
    return F.when(duration == 0, F.lit(0).cast("long")).otherwise((F.floor(duration / step) + 1) * step)


def split_label(day: Column, train_end: str, validation_end: str) -> Column:
    return F.when(day < train_end, "train").when(day < validation_end, "validation").otherwise("test")


#: Fixed patterns that route a question: a live lookup or an action, a stated value, the plant's
#: quantities and stations, documents.
LIVE = r"(?:실시간|현재|지금).{0,25}(?:조회|읽어|가져|몇\s*(?:도|암페어|명)|측정값.*알려)|(?:실제|직접).{0,15}(?:센서|측정값).{0,15}(?:조회|읽|가져)|(?:밸브|설비|라인|장비).{0,12}(?:실제로\s*)?(?:꺼줘|켜줘|정지시켜|가동해줘)|(?:조치|정지|교체).{0,12}(?:완료됐|실행됐|실행해줘)"
VALUES = r"(?i)\d+(?:\.\d+)?\s*(?:%\s*(?:RH)?|°\s*C|℃|도|bar(?![A-Za-z])|mm/s(?![A-Za-z])|m/s(?![A-Za-z])|A(?![A-Za-z])|N(?![A-Za-z])|회\s*(?:연속|이상|동안)|분|시간)"
DOMAIN = r"(?i)온도|습도|전류|압력|진동|장력|속도|센서|공정|실러|창고|연구실|실험실|포장|충전|실링|라벨|temperature|humidity|pressure|current|vibration"
DOCUMENT = r"(?i)문서|규칙|기준|정의|임계|정비|사양|우선순위|역할|출입|최대\s*인원|SOP-|DS-"
CANDIDATE = r"det-[0-9a-f]{20}|탐지\s*후보"


def route(question: Column) -> Column:
    """unavailable (a live lookup or an action), document, or null: other tools decide."""
    asks_document = (question.rlike(VALUES) & question.rlike(DOMAIN)) | (question.rlike(DOCUMENT) & ~question.rlike(CANDIDATE))
    return F.when(question.rlike(LIVE), "unavailable").when(asks_document, "document")


def numbered_ids(df: DataFrame, name: str, order: str) -> DataFrame:
    """Adds uid: the name, followed by '::part-n' where several rows have it."""
    from pyspark.sql.window import Window as W

    n, k = F.count("*").over(W.partitionBy(name)), F.row_number().over(W.partitionBy(name).orderBy(order))
    return df.withColumn("uid", F.when(n > 1, F.concat(F.col(name), F.lit("::part-"), k.cast("string"))).otherwise(F.col(name)))
