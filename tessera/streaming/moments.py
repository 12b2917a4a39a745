"""Moments, covariances and contingency tables of streams, per event-time window.

They are sums, so Structured Streaming keeps one small state a window and merges late
rows until the watermark passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.stats import aggregate


def windowed_moments(events: DataFrame, time: str, value: str, window: str, delay: str, by: Sequence[str] = (), adjust: bool = False) -> DataFrame:
    """Count, mean, variance, skewness and kurtosis per window and group."""
    x = F.col(value)
    names = ("mean", "variance", "skewness", "kurtosis")
    cells = [F.count(x).alias("n"), *[aggregate(n, x, adjust).alias(n) for n in names]]
    return events.withWatermark(time, delay).groupBy(F.window(time, window), *by).agg(*cells)


def windowed_covariance(events: DataFrame, time: str, columns: Sequence[str], window: str, delay: str) -> DataFrame:
    """Population covariances of the columns per window, as one row of cells i_j."""
    cells = [F.covar_pop(a, b).alias(f"{a}_{b}") for i, a in enumerate(columns) for b in columns[i:]]
    return events.withWatermark(time, delay).groupBy(F.window(time, window)).agg(*cells)


def windowed_contingency(events: DataFrame, time: str, row: str, column: str, window: str, delay: str) -> DataFrame:
    """Joint counts of two variables per window."""
    return events.withWatermark(time, delay).groupBy(F.window(time, window), row, column).agg(F.count(F.lit(1)).alias("n"))
