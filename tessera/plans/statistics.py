"""Queries of the summary statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import stats
from tessera.operators.frames import long, table

from .registry import plain, query, rounded

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _per_column(columns: list[str], cells: str, source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS variable, {cells.replace('$', c)} FROM {source}" for c in columns)


@query(_per_column(LINE, "round(avg($), 6) + 0.0 AS mean, round(var_samp($), 4) + 0.0 AS variance, round(skewness($), 6) + 0.0 AS skewness, round(kurtosis($), 6) + 0.0 AS kurtosis", "lineitem"))
def stat_moments_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, and adjusted variance, skewness and kurtosis of lineitem's numbers."""
    found = stats.on_columns(table(spark, sf_dir, "lineitem"), LINE, ["mean", "variance", "skewness", "kurtosis"], adjust=True)
    return rounded(rounded(found, 4, ["variance"]), 6, ["mean", "skewness", "kurtosis"])


@query(_per_column(LINE, "round(sum($), 2) + 0.0 AS sum, round(avg($), 6) + 0.0 AS mean, round(var_pop($) * count($), 1) + 0.0 AS sum_of_squared_deviations, round(var_pop($), 4) + 0.0 AS variance, round(stddev_pop($), 6) + 0.0 AS standard_deviation", "lineitem"))
def stat_columns_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.on_columns(table(spark, sf_dir, "lineitem"), LINE, ["sum", "mean", "sum_of_squared_deviations", "variance", "standard_deviation"])
    for digits, c in ((2, "sum"), (6, "mean"), (1, "sum_of_squared_deviations"), (4, "variance"), (6, "standard_deviation")):
        found = rounded(found, digits, [c])
    return found


@query(_per_column(LINE, "round(var_samp($), 4) + 0.0 AS variance, round(stddev_samp($), 6) + 0.0 AS standard_deviation", "lineitem"))
def stat_columns_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.on_columns(table(spark, sf_dir, "lineitem"), LINE, ["variance", "standard_deviation"], adjust=True)
    return rounded(rounded(found, 4, ["variance"]), 6, ["standard_deviation"])


_PART = ["p_size", "p_retailprice"]


def _centred(columns: list[str], source: str, g: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS variable, {g.replace('$', c)} FROM {source}, (SELECT avg({c}) AS mean_of FROM {source}) t" for c in columns)


@query(_centred(_PART, "part", "round(avg(($ - mean_of) ** 3) / pow(var_pop($), 1.5), 6) + 0.0 AS skewness, round(kurtosis_pop($), 6) + 0.0 AS kurtosis"))
def stat_shape_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.on_columns(table(spark, sf_dir, "part"), _PART, ["skewness", "kurtosis"]), 6)


_KEY = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
_LIST = "[l_quantity, l_extendedprice, l_discount, l_tax]"


@query(
    f"""SELECT {_KEY}, round(list_sum(v), 6) + 0.0 AS sum, round(list_avg(v), 6) + 0.0 AS mean, round(list_stddev_pop(v), 5) + 0.0 AS standard_deviation,
    round(list_min(v), 6) + 0.0 AS least, (list_position(v, list_min(v)) - 1)::INTEGER AS least_index,
    round(list_max(v), 6) + 0.0 AS most, (list_position(v, list_max(v)) - 1)::INTEGER AS most_index
    FROM (SELECT *, {_LIST} AS v FROM lineitem)"""
)
def stat_on_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each row's four numbers, without any shuffle."""
    found = stats.on_rows(table(spark, sf_dir, "lineitem"), LINE, ["sum", "mean", "standard_deviation", "min", "max"], keep=_KEY.split(", "))
    flat = found.select(
        *_KEY.split(", "), "sum", "mean", "standard_deviation", F.col("min.value").alias("least"), F.col("min.index").cast("int").alias("least_index"),
        F.col("max.value").alias("most"), F.col("max.index").cast("int").alias("most_index"),
    )
    return rounded(rounded(flat, 5, ["standard_deviation"]), 6, ["sum", "mean", "least", "most"])


_ALL = " UNION ALL ".join(f"SELECT {c} AS v FROM lineitem" for c in LINE)


@query(f"SELECT round(sum(v), 2) + 0.0 AS sum, round(avg(v), 6) + 0.0 AS mean, round(var_pop(v), 2) + 0.0 AS variance, round(kurtosis_pop(v), 6) + 0.0 AS kurtosis FROM ({_ALL})")
def stat_on_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.on_all(table(spark, sf_dir, "lineitem"), LINE, ["sum", "mean", "variance", "kurtosis"])
    return rounded(rounded(rounded(found, 2, ["sum", "variance"]), 6, ["mean"]), 6, ["kurtosis"])


PROBABILITIES = [0.005, 0.25, 0.5, 0.9, 0.999]


def _quantile_sql(source: str, group: str, value: str) -> str:
    probs = ", ".join(f"({p}::DOUBLE)" for p in PROBABILITIES)
    return f"""WITH r AS (SELECT {group} AS g, {value} AS v, row_number() OVER (PARTITION BY {group} ORDER BY {value}) AS k, count(*) OVER (PARTITION BY {group}) AS n FROM {source}),
    p AS (SELECT * FROM (VALUES {probs}) t(probability)),
    h AS (SELECT g, n, probability, greatest(1.0, least((n + 1.0/3) * probability + 1.0/3, n::DOUBLE)) AS h FROM (SELECT DISTINCT g, n FROM r), p)
    SELECT h.g AS {group}, probability, round(a.v + (h - floor(h)) * (b.v - a.v), 4) + 0.0 AS quantile
    FROM h JOIN r a ON a.g = h.g AND a.k = floor(h)::BIGINT JOIN r b ON b.g = h.g AND b.k = least(floor(h)::BIGINT + 1, h.n)"""


@query(_quantile_sql("(" + " UNION ALL ".join(f"SELECT '{c}' AS variable, {c}::DOUBLE AS v FROM lineitem" for c in LINE) + ")", "variable", "v"))
def stat_quantile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type 8 quantiles of each column, exact, without ordering a column in one task."""
    return rounded(stats.quantile_columns(table(spark, sf_dir, "lineitem"), LINE, PROBABILITIES), 4, ["quantile"])


@query(_quantile_sql("orders", "o_orderpriority", "o_totalprice"))
def stat_quantile_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.quantile(table(spark, sf_dir, "orders"), "o_totalprice", PROBABILITIES, ["o_orderpriority"]), 4, ["quantile"])


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, (SELECT min(p_partkey) FROM part WHERE {c} = (SELECT min({c}) FROM part)) AS min_index, (SELECT min({c}) FROM part)::DOUBLE AS min_value,
        (SELECT min(p_partkey) FROM part WHERE {c} = (SELECT max({c}) FROM part)) AS max_index, (SELECT max({c}) FROM part)::DOUBLE AS max_value"""
        for c in _PART
    )
)
def stat_min_max_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extremes with the least index at which they stand."""
    found = stats.on_columns(table(spark, sf_dir, "part"), _PART, ["min", "max"], index="p_partkey")
    return found.select("variable", *[F.col(f"{s}.{f}").alias(f"{s}_{f}") for s in ("min", "max") for f in ("index", "value")])


def _row_quantile_sql(p: float) -> str:
    h = max(1.0, min(4.0, (4 + 1 / 3) * p + 1 / 3))
    k = int(h)
    return f"round(v[{k}] + {h - k!r} * (v[{min(k + 1, 4)}] - v[{k}]), 5) + 0.0"


@query(f"SELECT {_KEY}, " + ", ".join(f"{_row_quantile_sql(p)} AS q{int(100 * p)}" for p in (0.1, 0.5, 0.8)) + f" FROM (SELECT *, list_sort({_LIST}) AS v FROM lineitem)")
def stat_quantile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of each row's four numbers, without any shuffle."""
    cells = [plain(stats.row_quantile(LINE, p), 5).alias(f"q{int(100 * p)}") for p in (0.1, 0.5, 0.8)]
    return table(spark, sf_dir, "lineitem").select(*_KEY.split(", "), *cells)


def _matrix_sql(f: str, digits: int) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, '{a}' AS variable_i, '{b}' AS variable_j, round({f}({a}, {b}), {digits}) + 0.0 AS value FROM lineitem" for i, a in enumerate(LINE) for j, b in enumerate(LINE))


@query(_matrix_sql("covar_pop", 4))
def stat_covariance_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.covariance(table(spark, sf_dir, "lineitem"), LINE), 4)


@query(_matrix_sql("covar_samp", 4))
def stat_covariance_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.covariance(table(spark, sf_dir, "lineitem"), LINE, adjust=True), 4)


@query(_matrix_sql("corr", 6))
def stat_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.correlation(table(spark, sf_dir, "lineitem"), LINE), 6)


@query("SELECT row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS position, s_suppkey AS index, s_acctbal AS value FROM supplier")
def stat_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values in order with where they were; ranges are ordered apart."""
    return stats.sort_entries(table(spark, sf_dir, "supplier"), "s_acctbal", "s_suppkey")


@query("SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS position, o_orderkey AS index FROM orders")
def stat_sort_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.sort_index(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey", descending=True)


@query("SELECT variable, round(sum(w * v) / sum(w), 6) + 0.0 AS mean, round(sum(w * v * v) / sum(w) - (sum(w * v) / sum(w)) ** 2, 3) + 0.0 AS variance FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, l_quantity AS w, {c} AS v FROM lineitem" for c in LINE[1:3]) + ") GROUP BY variable")
def stat_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.weighted_moments(table(spark, sf_dir, "lineitem"), LINE[1:3], "l_quantity")
    return rounded(rounded(found, 6, ["mean"]), 3, ["variance"])


_FLAT = " UNION ALL ".join(f"SELECT '{c}' AS variable, {c} AS v FROM lineitem" for c in LINE)


@query(f"SELECT variable, round(median(v), 6) + 0.0 AS middle FROM ({_FLAT}) GROUP BY variable")
def stat_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At probability 1/2 type 8 is the median."""
    found = stats.quantile(long(table(spark, sf_dir, "lineitem"), LINE), "value", [0.5], ["variable"])
    return rounded(found.select("variable", F.col("quantile").alias("middle")), 6)
