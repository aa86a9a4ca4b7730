"""All queries of the engine's own operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.plans import evaluation_queries, factor_queries, run_queries, text_queries

MODULES = (factor_queries, evaluation_queries, text_queries, run_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for m in MODULES for n, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {n: s for m in MODULES for n, s in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily information coefficients of a momentum factor."""
    return evaluation_queries.flagship(spark, sf_dir)
