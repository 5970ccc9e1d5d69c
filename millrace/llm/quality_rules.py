"""Quality rules as a short-circuit cascade, with DataFrame functions only.

Word statistics come from one pass over the text's own word array inside the row: nothing is
exploded or shuffled. A rule names the statistics that it reads and a condition on them that rejects
a row. On a sample each rule's cost (seconds to compute its statistics and judge them) and selectivity
(share it rejects) are estimated, and the cascade evaluates the rules by falling rejection per cost,
stopping at the first that rejects: what later rules read is then never computed. The order changes
the cost alone, never the verdict.

`keep` and `verdict` are that cascade. `apply_rules` also returns every statistic, which leaves the
cascade only the comparisons to save.

Windows of words are told apart by 64-bit hashes within one text. Null and empty texts have no words
and fail. Very long texts are read whole: sorting their windows takes n log n. Repeated rows stay
repeated, equal rows get equal verdicts, an empty table gives no rows. Columns of the input are kept;
those that the operator adds replace columns of the same name.
"""

from __future__ import annotations

import time
from collections import namedtuple
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES

SYMBOLS = "[#*$%&|<>]"
#: The statistics a rule reads, and the condition on them that rejects.
Rule = namedtuple("Rule", "reads rejects")

RULES: tuple[tuple[str, Rule], ...] = (
    ("symbols", Rule(("n_symbols", "n_words"), lambda n_symbols, n_words: 10 * n_symbols > n_words)),
    ("duplicate_lines", Rule(("n_dup_lines", "n_lines"), lambda n_dup_lines, n_lines: 2 * n_dup_lines > n_lines)),
    ("shouting", Rule(("n_marks", "n_words"), lambda n_marks, n_words: 2 * n_marks > n_words)),
    ("word_length", Rule(("word_chars", "n_words"), lambda word_chars, n_words: (word_chars < 2 * n_words) | (word_chars > 15 * n_words))),
    ("repeated_words", Rule(("n_repeat_words", "n_words"), lambda n_repeat_words, n_words: 100 * n_repeat_words > 30 * n_words)),
)
#: A row that one of these rejects is base_failed; the cascade holds them like the others.
BASE: tuple[tuple[str, Rule], ...] = (
    ("base_words", Rule(("n_words",), lambda n_words: n_words < 50)),
    ("base_repeats", Rule(("n_repeat_words", "n_words"), lambda n_repeat_words, n_words: 100 * n_repeat_words > 50 * n_words)),
)
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_marks", "n_repeat_words")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once for each row although body uses it inside lambdas."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def n_repeat_words(ws: Column, width: int = 3) -> Column:
    """Words that stand in a window of `width` words found twice or more in the array. Only where hashes
    of windows repeat are they sorted with their positions, so that equal ones are neighbours."""

    def covered(grams: Column) -> Column:
        at = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def positions(s: Column) -> Column:
            again = F.filter(
                F.transform(s, lambda x, j: F.when((x["g"] == F.get(s, j - 1)["g"]) | (x["g"] == F.get(s, j + 1)["g"]), x["i"])),
                lambda p: p.isNotNull(),
            )
            return F.sort_array(again)

        def total(p: Column) -> Column:
            return F.aggregate(
                p,
                F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                lambda a, i: F.struct((a["n"] + width - F.greatest(a["end"] - i, F.lit(0))).alias("n"), (i + width).alias("end")),
                lambda a: a["n"].cast("long"),
            )

        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(_let(_let(at, positions), total))

    grams = F.transform(F.sequence(F.lit(0), F.size(ws) - width), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(width)]))
    return F.when(F.size(ws) < width + 1, F.lit(0).cast("long")).otherwise(_let(grams, covered))


def _lines(text: Column, body: Callable[[Column, Column], Column]) -> Column:
    """body(lines with a word, lines equal to an earlier one)."""
    full = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return _let(full, lambda ls: body(F.size(ls).cast("long"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long")))


def _count(text: Column, marks: str) -> Column:
    return F.regexp_count(text, F.lit(marks))


def _statistic(name: str, text: Column, ws: Column) -> Column:
    """Any statistic but those of lines, of a text that isn't null and its words."""
    return {
        "n_words": lambda: F.size(ws).cast("long"),
        "word_chars": lambda: (F.length(text) - _count(text, r"[\x20\x09-\x0D]")).cast("long"),
        "n_symbols": lambda: _count(text, SYMBOLS).cast("long"),
        "n_marks": lambda: _count(text, "[!?]").cast("long"),
        "n_repeat_words": lambda: n_repeat_words(ws),
    }[name]()


def _rejects(rules: Sequence[Rule], text: Column, ws: Column) -> Column:
    """Whether one of the rules, which read the same statistics, rejects; these are computed once."""
    reads = rules[0].reads

    def judge(lines: Column | None, dups: Column | None) -> Column:
        known = {"n_lines": lines, "n_dup_lines": dups}
        stats = F.struct(*[(known[r] if r in known else _statistic(r, text, ws)).alias(r) for r in reads])

        def either(s: Column) -> Column:
            out = rules[0].rejects(*[s[r] for r in reads])
            for rule in rules[1:]:
                out = out | rule.rejects(*[s[r] for r in reads])
            return out

        return _let(stats, either)

    return _lines(text, judge) if {"n_lines", "n_dup_lines"} & set(reads) else judge(None, None)


def with_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds STATISTICS. The generator keeps the optimizer from computing them again in a filter."""
    t = F.coalesce(F.col(text), F.lit(""))

    def all_of(ws: Column) -> Column:
        return _lines(t, lambda n, dups: F.struct(*[({"n_lines": n, "n_dup_lines": dups}.get(s) if s.endswith("lines") else _statistic(s, t, ws)).alias(s) for s in STATISTICS]))

    return df.select(*[c for c in df.columns if c not in STATISTICS], F.inline(F.array(_let(words(F.col(text)), all_of))))


def cascade_order(df: DataFrame, rules: Sequence[tuple[str, Rule]] = RULES, text: str = "text", sample_rows: int = 2000, seed: int = 7) -> list[str]:
    """Names of the rules by falling (share rejected) / (seconds to evaluate) on a sample of about
    `sample_rows` rows. Each rule is timed by itself, less what reading the words takes."""
    n = df.count()
    if not n:
        return [name for name, _ in rules]
    t = F.coalesce(F.col(text), F.lit(""))
    sample = df.select(text).sample(min(1.0, sample_rows / n), seed).persist()

    def timed(condition: Callable[[Column], Column]) -> tuple[int, float]:
        began = time.perf_counter()
        hits = sample.select(F.inline(F.array(F.struct(_let(words(F.col(text)), condition).alias("hit"))))).agg(F.count_if("hit")).first()[0]
        return hits, time.perf_counter() - began

    try:
        rows = max(1, sample.count())
        timed(lambda ws: F.size(ws) < 0)  # compiles and warms up
        least = timed(lambda ws: F.size(ws) < 0)[1]
        worth = {}
        for name, rule in rules:
            hits, seconds = timed(lambda ws, rule=rule: _rejects([rule], t, ws))
            worth[name] = hits / rows / max(seconds - least, 1e-3)
    finally:
        sample.unpersist()
    return sorted(worth, key=lambda k: (-worth[k], k))


def verdict(text: str = "text", rules: Sequence[tuple[str, Rule]] = RULES, order: Sequence[str] | None = None) -> Column:
    """Whether the cascade, the rules of BASE included, keeps the row. Rules that read the same
    statistics are one step, at the place of the first of them."""
    t = F.coalesce(F.col(text), F.lit(""))
    by_name = dict([*BASE, *rules])
    steps: dict[tuple[str, ...], list[Rule]] = {}
    for name in [*(order or ()), *[n for n in by_name if n not in (order or ())]]:
        steps.setdefault(by_name[name].reads, []).append(by_name[name])

    def cascade(ws: Column) -> Column:
        out = F.when(F.lit(False), F.lit(False))
        for step in steps.values():
            out = out.when(_rejects(step, t, ws), F.lit(False))
        return out.otherwise(F.lit(True))

    return _let(words(F.col(text)), cascade)


def keep(df: DataFrame, rules: Sequence[tuple[str, Rule]] = RULES, text: str = "text", order: Sequence[str] | None = None, sample_rows: int = 2000) -> DataFrame:
    """The rows of df that the cascade keeps, with their own columns, whatever the names. A statistic is
    computed for the rows alone that reach the first rule that reads it."""
    names = df.columns
    safe = df.toDF(*[f"c{i}" for i in range(len(names))])
    at = f"c{names.index(text)}"
    order = cascade_order(safe, [*BASE, *rules], at, sample_rows) if order is None else order
    judged = safe.select("*", F.inline(F.array(F.struct(verdict(at, rules, order).alias("kept")))))
    return judged.where("kept").select(*safe.columns).toDF(*names)


def apply_rules(df: DataFrame, rules: Sequence[tuple[str, Rule]] = RULES, text: str = "text", order: list[str] | None = None, sample_rows: int = 2000) -> DataFrame:
    """Adds STATISTICS, base_failed and kept. kept is false for base failures and for rows that a rule
    of the cascade rejects; the first to reject ends the evaluation."""
    order = cascade_order(df, rules, text, sample_rows) if order is None else order
    by_name = dict(rules)
    rejects = lambda rule: rule.rejects(*[F.col(r) for r in rule.reads])
    kept = F.when(F.col("base_failed"), F.lit(False))
    for name in order:
        kept = kept.when(rejects(by_name[name]), F.lit(False))
    failed = rejects(BASE[0][1]) | rejects(BASE[1][1])
    return with_stats(df, text).withColumn("base_failed", failed).withColumn("kept", kept.otherwise(F.lit(True)))
