"""Query catalogue of the evidence engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstone.plans import documents, relational, streams  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval for all benchmark questions over all documents."""
    return documents.q_rank_hybrid(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(relational.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(relational.ORACLES)
