"""Frames: wide and long forms, row numbers, lineage cuts, safe arithmetic."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() in the cluster's shared folder; a temporary one only where none is set and all is one machine."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, set as the session's checkpoint folder."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-"))
    return context.getCheckpointDir()


def long(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), name: str = "variable", value: str = "value") -> DataFrame:
    """Wide to long: one row per row and column; no shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, f"_p.{name}", f"_p.{value}")


def unpivot_row(row: DataFrame, columns: Sequence[str], fields: Sequence[str], name: str = "variable") -> DataFrame:
    """One row with cells `column__field` to a row per column."""
    items = [F.struct(F.lit(c).alias(name), *[F.col(f"{c}__{f}").alias(f) for f in fields]) for c in columns]
    return row.select(F.explode(F.array(*items)).alias("_p")).select("_p.*")


def with_running(df: DataFrame, order: Sequence[str | Column], sums: dict[str, Column]) -> DataFrame:
    """Running sums (the row's own term included) along `order`, without one task for all rows.

    Rows are dealt by ranges of the order and kept so (a checkpoint); each range is
    summed on its own, upon the totals of the ranges before it.
    """
    terms = {f"_t_{k}": c for k, c in sums.items()}
    dealt = cut_lineage(df.withColumns(terms).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy("_part").agg(*[F.sum(f"_t_{k}").alias(f"_b_{k}") for k in sums])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_b_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums])
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumns({f"_t_{k}": F.sum(f"_t_{k}").over(own) for k in sums}).join(F.broadcast(offsets), "_part")
    return summed.withColumns({k: F.col(f"_t_{k}") + F.col(f"_b_{k}") for k in sums}).drop("_part", *terms, *[f"_b_{k}" for k in sums])


def with_row_id(df: DataFrame, order: Sequence[str | Column], name: str = "row_id", start: int = 0) -> DataFrame:
    """Number the rows by `order`, range by range."""
    return with_running(df, order, {name: F.lit(1).cast("long")}).withColumn(name, F.col(name) - 1 + start)


def ieee_divide(a: Column, b: Column) -> Column:
    """a / b as IEEE has it: by zero gives an infinity or NaN, where Spark would raise."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def fsum(columns: Sequence[Column]) -> Column:
    """The sum of some columns as one expression."""
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out
