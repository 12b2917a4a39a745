"""Queries of sources, sinks and streams: what goes out comes back."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.categorical import encode
from tessera.operators.frames import checkpoint_folder, table
from tessera.operators.matrix import Matrix
from tessera.sources import matrix_files
from tessera.streaming.moments import windowed_contingency, windowed_covariance, windowed_moments

from .registry import plain, query, rounded


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder among the shared ones."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _prices(spark: SparkSession, sf_dir: str) -> Matrix:
    df = table(spark, sf_dir, "part")
    return Matrix.from_wide(df, "p_partkey", ["p_size", "p_retailprice"])


_BACK = "SELECT p_partkey AS i, 0 AS j, p_size::DOUBLE AS v FROM part UNION ALL SELECT p_partkey, 1, p_retailprice FROM part"


@query(_BACK)
def io_csv_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "csv")
    matrix_files.write_csv(_prices(spark, sf_dir), path)
    return matrix_files.read_csv(spark, path).entries.where("v <> 0").select("i", "j", "v")


@query(_BACK)
def io_csv_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "csv")
    matrix_files.write_csv(_prices(spark, sf_dir), path, sparse=True)
    return matrix_files.read_csv(spark, path).entries.select("i", "j", "v")


@query("SELECT n_nationkey::BIGINT AS i, n_regionkey AS j, 1.0::DOUBLE AS v FROM nation")
def io_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("i"), F.col("n_regionkey").cast("int").alias("j"), F.lit(1.0).alias("v"))
    return matrix_files.read_matrix_json(matrix_files.matrix_json(Matrix(cells, 25, 5), sparse=True)).entries


@query("SELECT c_custkey AS row_id, c_mktsegment FROM customer")
def io_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "categorical")
    matrix_files.write_categorical(encode(table(spark, sf_dir, "customer"), "c_custkey", ["c_mktsegment"]), path)
    return matrix_files.read_categorical(spark, path).decode()


@query("SELECT event_type, epoch(time_bucket(INTERVAL 1 day, ts))::BIGINT AS day, count(value)::BIGINT AS n, round(avg(value), 6) + 0.0 AS mean, round(var_pop(value), 4) + 0.0 AS variance FROM events GROUP BY 1, 2")
def stream_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments per day and type over the events as a stream."""
    found = _streamed(spark, sf_dir, "moments", lambda e: windowed_moments(e, "ts", "value", "1 day", "30 days", ["event_type"]))
    out = found.select("event_type", F.unix_timestamp("window.start").alias("day"), "n", "mean", "variance")
    return rounded(rounded(out, 6, ["mean"]), 4, ["variance"])


_DAYS = "epoch(time_bucket(INTERVAL 1 day, ts))::BIGINT AS day"


def _streamed(spark: SparkSession, sf_dir: str, what: str, make) -> DataFrame:  # noqa: ANN001
    """The result of a windowed aggregation over the events as a stream."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    name = f"{what}_{uuid.uuid4().hex}"
    run = make(events).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


@query(f"SELECT {_DAYS}, round(covar_pop(value, value), 4) + 0.0 AS own, round(covar_pop(value, user_id::DOUBLE), 2) + 0.0 AS shared FROM events GROUP BY 1")
def stream_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariances per day over the events as a stream."""
    make = lambda e: windowed_covariance(e.withColumn("user", F.col("user_id").cast("double")), "ts", ["value", "user"], "1 day", "30 days")
    out = _streamed(spark, sf_dir, "covariance", make)
    return out.select(F.unix_timestamp("window.start").alias("day"), plain(F.col("value_value"), 4).alias("own"), plain(F.col("value_user"), 2).alias("shared"))


@query(f"SELECT {_DAYS}, event_type, user_id % 3 AS third, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def stream_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joint counts per day over the events as a stream."""
    make = lambda e: windowed_contingency(e.withColumn("third", F.col("user_id") % 3), "ts", "event_type", "third", "1 day", "30 days")
    return _streamed(spark, sf_dir, "contingency", make).select(F.unix_timestamp("window.start").alias("day"), "event_type", "third", "n")


@query("SELECT o_orderkey, round(sin(o_totalprice / 1000) * sqrt(o_totalprice), 6) + 0.0 AS v FROM orders")
def apply_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An arbitrary Python function of entries, by Arrow batches."""
    df = table(spark, sf_dir, "orders")
    m = Matrix.from_wide(df, "o_orderkey", ["o_totalprice"])
    out = m.apply_python(lambda v: math.sin(v / 1000) * math.sqrt(v))
    return out.entries.join(df.select(F.col("o_orderkey").alias("i")), "i", "left_semi").select(F.col("i").alias("o_orderkey"), plain(F.col("v"), 6).alias("v"))
