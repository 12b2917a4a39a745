"""Registration of queries with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name; sql is None where SQL can't express it."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int, columns: list[str] | None = None) -> DataFrame:
    """Doubles rounded, without negative zeros: both engines then agree to the digit."""
    chosen = [c for c, t in df.dtypes if t == "double" and (columns is None or c in columns)]
    return df.withColumns({c: plain(F.col(c), digits) for c in chosen})


def plain(c: Column, digits: int) -> Column:
    return F.round(c, digits) + F.lit(0.0)
