"""The corpus pipeline: quality rules, near-dedup, decontamination, redaction, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents; the last returns
the mix: doc_id, size, source_size, target, copies and taken. Further columns pass through all but the
last, whatever their names; an empty table stays empty; very long texts are never cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import common, decontam, mixing, near_copies, pii, quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the cascade keeps. Null, empty and wordless texts go; long ones are read whole."""
    return quality_rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, Jaccard of 0.8 or more), that
    with the smallest doc_id; rows that repeat an id and a text count once; null ids never name a group."""
    return near_copies.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold benchmark passages to a twentieth of their words; null texts stay."""
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars, where docs has it, follows the new
    text. Null texts stay null."""
    return pii.redact(docs, length="n_chars" if "n_chars" in docs.columns else None)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; null texts have size 0, a null source is one of its own."""
    return mixing.mix(docs)


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("decontamination", decontaminate), ("pii", redact), ("mix", mix)]

#: The stages after the first have no SQL form (XXH64 fingerprints, leftmost matches, random rounding).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = common.save(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
