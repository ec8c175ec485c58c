"""The registered queries of the evidence engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import changes, judgements, lifecycle, literals, placements, structural


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to chunks to a scope claim each, with the page that proves it."""
    return structural.q_verify_citations(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return structural.QUERIES | lifecycle.QUERIES | judgements.QUERIES | placements.QUERIES | changes.QUERIES | literals.QUERIES


def oracle_sql() -> dict[str, str]:
    return structural.SQL | lifecycle.SQL | judgements.SQL | placements.SQL | changes.SQL | literals.SQL
