"""Scalar functions of text, identifiers, vectors and time as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze(x: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def canonical_id(x: Column) -> Column:
    """What follows the last '::'."""
    return F.element_at(F.split(x, "::"), -1)


def short_name(x: Column) -> Column:
    """What follows the last '#' or '/', percent-decoded."""
    return F.url_decode(F.regexp_extract(x, r"([^#/]*)$", 1))


def station_of(sensor: Column) -> Column:
    """The sensor id without its last '_' part."""
    return F.regexp_replace(sensor, "_[^_]*$", "")


def sha256(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def content_id(prefix: str, *cols: Column) -> Column:
    """prefix and 20 digits of the SHA-256 of the columns as text, each with its length in front."""
    parts = [F.concat(F.coalesce(F.length(c.cast("string")).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(c.cast("string"), F.lit(""))) for c in cols]
    return F.concat(F.lit(prefix), F.substring(sha256(F.concat_ws("|", *parts)), 1, 20))


def mentions(text: Column, alias: Column | str) -> Column:
    """Whether the alias stands in the text, case aside: an ASCII alias not preceded by a letter,
    digit, '_' or '-' nor followed by a letter, digit or '_'; any other as a plain substring."""
    a = F.lit(alias) if isinstance(alias, str) else alias
    escaped = F.regexp_replace(a, r"([\\.^$|?*+()\[\]{}-])", r"\\$1")
    pattern = F.concat(F.lit("(?i)(?<![A-Za-z0-9_-])"), escaped, F.lit("(?![A-Za-z0-9_])"))
    return F.when(a.rlike(r"^[\x00-\x7F]*$"), F.regexp_like(text, pattern)).otherwise(F.contains(F.lower(text), F.lower(a)))


#: Fixed list of Korean particles that end a token, in the order they are tried.
PARTICLES = ("에서는", "으로는", "에서", "으로", "에게", "까지", "부터", "보다", "은", "는", "이", "가", "을", "를", "의", "에", "와", "과", "도", "로", "만")
#: Fixed pattern of a token.
TOKEN = r"[a-z0-9]+(?:[-_.][a-z0-9]+)*|[가-힣]+"


def parts_of(w: Column) -> Column:
    """What a token adds to itself: its parts, if it has '-' or '_', or, of a Hangul word, the word without
    a particle if two characters stay. Most tokens are neither and are told by a look at their characters."""
    none = F.array().cast("array<string>")
    stem = F.regexp_extract(w, "^(.{2,}?)(?:" + "|".join(PARTICLES) + ")$", 1)
    joined = F.contains(w, F.lit("-")) | F.contains(w, F.lit("_"))
    return F.when(joined, F.filter(F.split(w, "[-_]"), lambda p: p != "")).when((w >= "가") & (stem != ""), F.array(stem)).otherwise(none)


def tokens(text: Column) -> Column:
    """Lower-cased tokens: runs of letters and digits joined by '-', '_' or '.', and Hangul words. A
    token with '-' or '_' is followed by its parts, a Hangul word by itself without a particle if two
    characters stay."""
    raw = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    # most texts have no such token, and are done with the pattern
    return F.when(text.rlike("[-_가-힣]"), F.flatten(F.transform(raw, lambda w: F.concat(F.array(w), parts_of(w))))).otherwise(raw)


def row_text(header: Column, values: Column) -> Column:
    """'header: value; …' of a table row, empty values left out."""
    pairs = F.zip_with(header, values, lambda h, v: F.when(F.length(F.trim(v)) > 0, F.concat(h, F.lit(": "), v)))
    return F.array_join(F.filter(pairs, lambda p: p.isNotNull()), "; ")


def table_rows(title: Column, text: Column) -> Column:
    """Array of (row, text): each non-empty line of a table's text under its title, rows from 1."""
    lines = F.filter(F.split(text, "\n"), lambda s: F.length(F.trim(s)) > 0)
    return F.transform(lines, lambda s, i: F.struct((i + 1).alias("row"), F.concat_ws("\n", title, s).alias("text")))


def embedding_text(doc: Column, section: Column, text: Column, names: Column | None = None) -> Column:
    head = F.concat_ws(" | ", doc, section)
    return F.concat_ws("\n", head, names, text) if names is not None else F.concat_ws("\n", head, text)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """The vector over its Euclidean length; null where the length is 0 or not finite."""
    norm = F.sqrt(dot(v, v))
    return F.when((norm > 0) & (norm < float("inf")), F.transform(v, lambda x: x.cast("double") / norm))


def finite_decimal(x: Column, precision: int = 38, scale: int = 18) -> Column:
    """The text as an exact decimal; null where it isn't a finite number."""
    return F.when(F.trim(x).rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]{1,3})?$"), F.trim(x)).try_cast(f"decimal({precision},{scale})")


def plus_minus(x: Column) -> Column:
    """'nominal ± tolerance' as a struct of nominal, tolerance, lo and hi."""
    parts = F.split(x, "±")
    n, t = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    n, t = F.trim(n).try_cast("decimal(18,6)"), F.trim(t).try_cast("decimal(18,6)")
    return F.struct(n.alias("nominal"), t.alias("tolerance"), (n - t).alias("lo"), (n + t).alias("hi"))


def window_id(sensor: Column, t: Column) -> Column:
    """Sensor and time to the minute."""
    return F.concat(sensor, F.lit("@"), F.date_format(F.timestamp_seconds(t), "yyyyMMdd'T'HHmm"))


def word_count(x: Column) -> Column:
    """Words and single marks: the stand-in for a tokenizer's count."""
    return F.regexp_count(x, F.lit(r"\w+|[^\w\s]")).cast("long")


#: Pairs of characters that extraction confuses, the wrong one first.
GLYPHS = (("µ", "μ"), ("º", "°"), ("–", "-"), ("—", "-"), ("−", "-"), ("’", "'"), ("‘", "'"), ("“", '"'), ("”", '"'), (" ", " "))


def repair_glyphs(x: Column) -> Column:
    return F.translate(x, "".join(a for a, _ in GLYPHS), "".join(b for _, b in GLYPHS))


def cited_ids(text: Column, pattern: str = r"\[([A-Za-z0-9:_#-]+)\]") -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))))


def chunks(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Array of (start, text) of a fixed stride: size code points, overlap shared with the next."""
    n = F.length(text)
    count = F.greatest(F.lit(1), F.ceil((n - overlap) / (size - overlap)).cast("int"))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((i * (size - overlap)).alias("start"), F.substring(text, i * (size - overlap) + 1, F.lit(size)).alias("text")))
