"""Queries of the training-data operators, one for each, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, katz, licenses, mixing, ordinal, pii, quality_rules, simhash, substring_dedup, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(_read(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(_read(spark, sf_dir, "pages"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths: each document's is its source, two directory levels of its id, and a
    name, which is LICENSE for one document in 25."""
    d = F.col("doc_id")
    name = F.when(d % 25 == 12, F.lit("LICENSE")).otherwise(F.concat(d.cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(d / 10_000).cast("string"), F.floor(d / 500).cast("string"), name)
    files = _read(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    return licenses.inherit(licenses.detect(files, keep=("doc_id", "path")))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also scores: that of each span, in the order of spans."""
    found = pii.scan(_read(spark, sf_dir, "documents"))
    return found.withColumn("scores", F.array_join(F.transform("found", lambda s: F.round(s["score"], 2).cast("string")), ",")).drop("found")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(_read(spark, sf_dir, "documents"))


def op7_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 toxic, 1 of low quality, 2 good. The model learns from labelled documents whose
    crc32 of the id, modulo 10, is not 0; every document is scored, and kept if grade 2 is likely."""
    docs = _read(spark, sf_dir, "documents")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    labels = _read(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0)
    return ordinal.score(docs, ordinal.fit(docs, labels.select("doc_id", grade.alias("grade")), 3))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.scan(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), with_matches=False).drop("matches")


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_katz, op2_quality_rules, op3_warc, op4_licenses, op5_pii, op6_substring_dedup, op7_ordinal_quality, op8_simhash, op9_decontaminate, op10_mix)}


_OP2 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: {'i': i, 'g': ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]})) AS x FROM d),
again AS (SELECT doc_id, x.i AS i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, x.g) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
s AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         len(ls) AS n_lines, length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_marks
  FROM d LEFT JOIN cov USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
            OR 2 * n_marks > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_repeat_words > 30 * n_words) AS kept
FROM s
"""

_WORDS9 = r"list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
_OP9 = f"""
WITH b AS (SELECT item_id, {_WORDS9} AS ws FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, n, array_to_string(ws[i : i + n - 1], ' ') AS w
        FROM (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, coalesce({_WORDS9}, []::VARCHAR[]) AS ws FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: {{'i': i, 'w': array_to_string(ws[i : i + n - 1], ' ')}})) AS x FROM d, sizes WHERE len(ws) >= n),
hits AS (SELECT doc_id, win.item_id, dw.n, x.i AS i FROM dw JOIN win ON dw.n = win.n AND x.w = win.w),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN items USING (doc_id)
"""


_OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h)::BIGINT AS n, sha256(h) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first FROM q WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, q.digest AS payload_digest,
       CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
FROM q LEFT JOIN f USING (digest)
"""

_OP6 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
w AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 18), lambda i: {'i': i, 'w': array_to_string(ws[i : i + 19], ' ')})) AS x FROM d WHERE len(ws) >= 20),
late AS (SELECT doc_id, x.i AS i FROM w QUALIFY row_number() OVER (PARTITION BY x.w ORDER BY doc_id, x.i) > 1),
cov AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM late) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN cov USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": _OP2, "op3_warc": _OP3, "op6_substring_dedup": _OP6, "op9_decontaminate": _OP9}
