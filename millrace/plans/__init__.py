"""Registered queries: each a DataFrame plan over the tables, with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import detection, dispatch, graphs, modes, paths, proofs, retrieval, shapes, stateful, verification  # noqa: F401
from .registry import ORACLES, QUERIES, Tables


def queries():
    """All queries by name, those over a cut of their tables included (for small fixtures)."""
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)


def whole() -> set[str]:
    """Names of the queries that run over whole tables: a cut one has a twin named `…_all` in its place."""
    return {n for n in QUERIES if f"{n}_all" not in QUERIES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.flagship(Tables(spark, sf_dir))
