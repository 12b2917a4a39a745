"""The registered queries over the driver's tables and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import algebra, categories, models, statistics, transfers  # noqa: F401  each registers its queries
from .registry import ORACLE_SQL, QUERIES, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.stat_moments_adjusted(spark, sf_dir)


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLE_SQL
