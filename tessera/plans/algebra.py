"""Queries of the matrix operators, over the embeddings as a matrix of rows by components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import indexes, multivariate
from tessera.operators.frames import table
from tessera.operators.matrix import Matrix

from .registry import plain, query

DIMS = 64
_CELLS = "SELECT vec_id AS i, (unnest(range(64)))::INTEGER AS j, unnest(embedding)::DOUBLE AS v FROM embeddings"
_A = f"a AS ({_CELLS})"
_N = "n AS (SELECT max(vec_id) + 1 AS n FROM embeddings)"
_B = "b AS (SELECT n - 1 - i AS i, j, v FROM a, n)"


def _matrix(spark: SparkSession, sf_dir: str) -> Matrix:
    df = table(spark, sf_dir, "embeddings")
    return Matrix.from_vectors(df, "vec_id", "embedding", df.agg(F.max("vec_id")).first()[0] + 1, DIMS)


def _flipped(m: Matrix) -> Matrix:
    """The rows from last to first."""
    return Matrix(m.entries.withColumn("i", F.lit(m.n_rows - 1) - F.col("i")), m.n_rows, m.n_cols)


def _cells(m: Matrix, digits: int = 6) -> DataFrame:
    return m.filled().select("i", "j", plain(F.col("v"), digits).alias("v"))


def _pairwise(op: str) -> str:
    return f"WITH {_A}, {_N}, {_B} SELECT a.i, a.j, round(a.v {op} b.v, 6) + 0.0 AS v FROM a JOIN b USING (i, j)"


@query(_pairwise("+"))
def mat_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matrix(spark, sf_dir)
    return _cells(m + _flipped(m))


@query(_pairwise("-"))
def mat_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matrix(spark, sf_dir)
    return _cells(m - _flipped(m))


@query(_pairwise("*"))
def mat_hadamard(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matrix(spark, sf_dir)
    return _cells(m.hadamard(_flipped(m)))


def _mapped(expression: str) -> str:
    return f"WITH {_A} SELECT i, j, round({expression}, 6) + 0.0 AS v FROM a"


@query(_mapped("2.5 * v"))
def mat_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(_matrix(spark, sf_dir) * 2.5)


@query(_mapped("v / 3.0"))
def mat_divide_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(_matrix(spark, sf_dir) / 3.0)


@query(_mapped("v + 1.0"))
def mat_add_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(_matrix(spark, sf_dir) + 1.0)


@query(_mapped("-v"))
def mat_negate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(-_matrix(spark, sf_dir))


@query(_mapped("v * v + 1"))
def mat_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(_matrix(spark, sf_dir).apply(lambda v: v * v + 1.0))


@query(f"WITH {_A} SELECT j::BIGINT AS i, i::INTEGER AS j, round(v, 6) + 0.0 AS v FROM a")
def mat_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(_matrix(spark, sf_dir).transpose())


_GRAM = f"WITH {_A} SELECT x.j::BIGINT AS i, y.j AS j, round(sum(x.v * y.v), 6) + 0.0 AS v FROM a x JOIN a y USING (i) GROUP BY x.j, y.j"


@query(_GRAM)
def mat_multiply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transpose times the matrix, by the general product."""
    m = _matrix(spark, sf_dir)
    return _cells(m.transpose() * m)


@query(_GRAM)
def mat_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by one pass over rows."""
    return _cells(_matrix(spark, sf_dir).gram())


@query(f"WITH {_A}, {_N}, {_B} SELECT a.i, a.j, round(a.v - 2 * b.v, 6) + 0.0 AS re, round(b.v + 2 * a.v, 6) + 0.0 AS im FROM a JOIN b USING (i, j)")
def mat_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(A + iB) scaled by 1 + 2i."""
    m = _matrix(spark, sf_dir)
    z = (m.as_complex() + _flipped(m) * 1j) * (1 + 2j)
    return z.filled().select("i", "j", plain(F.col("v.re"), 6).alias("re"), plain(F.col("v.im"), 6).alias("im"))


@query(f"WITH {_A}, {_N} SELECT i + j * n AS l FROM a, n WHERE v > 0.25")
def mat_find_while(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir).find_while(lambda v: v > 0.25)


_COUNTS = "c AS (SELECT n_nationkey AS i, n_regionkey AS j, count(*)::DOUBLE AS v FROM nation GROUP BY ALL)"


def _counts(spark: SparkSession, sf_dir: str) -> Matrix:
    """Nations by regions: a sparse matrix of counts."""
    c = table(spark, sf_dir, "nation").groupBy(F.col("n_nationkey").cast("long").alias("i"), F.col("n_regionkey").cast("int").alias("j")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    return Matrix(c, 25, 5)


@query(f"WITH {_COUNTS} SELECT (i + j * 25)::BIGINT AS l FROM c WHERE v <> 0")
def mat_find_nonzero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).find_nonzero()


@query(f"WITH {_COUNTS}, g AS (SELECT a.i, b.i::INTEGER AS j FROM range(25) a(i), range(5) b(i)) SELECT g.i + g.j * 25 AS l FROM g LEFT JOIN c ON g.i = c.i AND g.j = c.j WHERE coalesce(v, 0) = 0")
def mat_find_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).find(0.0)


@query(f"WITH {_A} SELECT a.i AS i, s.p AS j, round(v, 6) + 0.0 AS v FROM a JOIN (VALUES (0, 3), (1, 1), (2, 1), (3, 60)) s(p, c) ON a.j = s.c")
def mat_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns 3, 1, 1 and 60 of all rows."""
    return _cells(_matrix(spark, sf_dir).slice(":", [3, 1, 1, 60]))


@query(f"WITH {_A}, {_N} SELECT i + j * n AS l, round(v, 6) + 0.0 AS v FROM a, n")
def mat_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    stacked = _matrix(spark, sf_dir).vec()
    return stacked.filled().select(F.col("i").alias("l"), plain(F.col("v"), 6).alias("v"))


@query(f"WITH {_COUNTS} SELECT greatest(0, max(i - j))::BIGINT AS lower, greatest(0, max(j - i))::BIGINT AS upper FROM c WHERE v <> 0")
def mat_bandwidths(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, up = _counts(spark, sf_dir).bandwidths()
    return spark.range(1).select(F.lit(low).cast("long").alias("lower"), F.lit(up).cast("long").alias("upper"))


_SQUARE = "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS i, n_regionkey AS j, (n_nationkey + 1)::DOUBLE AS v FROM nation QUALIFY i < 5"


def _bands(tests: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS pattern, {test} AS holds FROM w" for name, test in tests.items())


@query(
    f"""WITH c AS ({_SQUARE}), p AS (SELECT a.i::BIGINT AS i, b.i::INTEGER AS j, sum(a.v * b.v) AS v FROM c a JOIN c b USING (j) GROUP BY ALL),
    w AS (SELECT greatest(0, max(i - j)) AS low, greatest(0, max(j - i)) AS up, bool_and(EXISTS (SELECT 1 FROM p q WHERE q.i = p.j AND q.j = p.i AND q.v = p.v)) AS even, bool_and(v = 0) AS odd FROM p WHERE v <> 0) """
    + _bands({
        "vector": "false", "row_vector": "false", "column_vector": "false", "scalar": "false", "square": "true", "symmetric": "even", "skew_symmetric": "odd", "diagonal": "low = 0 AND up = 0",
        "lower_triangular": "up = 0", "upper_triangular": "low = 0", "triangular": "least(low, up) = 0", "lower_hessenberg": "up <= 1", "upper_hessenberg": "low <= 1", "hessenberg": "least(low, up) <= 1",
        "tridiagonal": "greatest(low, up) <= 1", "lower_bidiagonal": "up = 0 AND low <= 1", "upper_bidiagonal": "low = 0 AND up <= 1", "bidiagonal": "least(low, up) = 0 AND greatest(low, up) <= 1",
    })
)
def mat_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All patterns of a product of a matrix of nations by regions with its transpose."""
    first = table(spark, sf_dir, "nation").orderBy("n_nationkey").limit(5)
    cells = first.select((F.col("n_nationkey")).cast("long").alias("i"), F.col("n_regionkey").cast("int").alias("j"), (F.col("n_nationkey") + 1.0).alias("v"))
    c = Matrix(cells, 5, 5)
    return spark.createDataFrame(list((c * c.transpose()).patterns().items()), "pattern string, holds boolean")


@query(f"WITH {_A}, {_N} SELECT i, j, round(CASE WHEN j IN (3, 60) THEN 2.5 WHEN i = n - 1 THEN 0 WHEN j = 7 THEN v + 1 ELSE v END, 6) + 0.0 AS v FROM a, n")
def mat_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column from a matrix, then a row and two columns from numbers."""
    m = _matrix(spark, sf_dir)
    return _cells(m.assign(":", 7, m.slice(":", [7]) + 1.0).assign(m.n_rows - 1, ":", 0.0).assign(":", [3, 60], 2.5))


@query("SELECT row_number() OVER (ORDER BY n_regionkey DESC) - 1 AS position, count(*) AS members FROM nation GROUP BY n_regionkey")
def mat_ordered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct rows in lexicographic order, with how often each stands."""
    return _counts(spark, sf_dir).ordered_rows().select(F.col("position").cast("long").alias("position"), F.size("members").cast("long").alias("members"))


@query("SELECT count(*)::BIGINT * 64 AS cells, true AS solved FROM embeddings")
def mat_divide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The X with X * G = A, G a regular square, checked by multiplying back."""
    m = _matrix(spark, sf_dir)
    g = m.gram() + Matrix.identity(spark, DIMS)
    x = m / g
    gap = (x * g - m).entries
    return gap.agg(F.count(F.lit(1)).alias("cells"), (F.max(F.abs("v")) < 1e-8).alias("solved"))


@query("SELECT label, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS members, count(*) AS size FROM embeddings GROUP BY label")
def index_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index lists gathered, sorted and measured."""
    held = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.collect_list("vec_id").alias("ids"))
    ids = indexes.ordered(F.col("ids"))
    return held.select("label", F.array_join(ids.cast("array<string>"), ",").alias("members"), F.size(ids).cast("long").alias("size"))


@query("SELECT a.label AS a, b.label AS b, CASE WHEN a.n < b.n OR (a.n = b.n AND a.first < b.first) THEN -1 ELSE 1 END AS compared FROM (SELECT label, count(*) AS n, min(vec_id) AS first FROM embeddings GROUP BY label) a JOIN (SELECT label, count(*) AS n, min(vec_id) AS first FROM embeddings GROUP BY label) b ON a.label < b.label")
def index_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of index lists in shortlex order."""
    held = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    a, b = held.toDF("a", "x"), held.toDF("b", "y")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", indexes.compare(F.col("x"), F.col("y")).alias("compared"))


@query(
    f"""WITH {_A}, g AS (SELECT x.j AS i, y.j AS j, sum(x.v * y.v) AS v FROM a x JOIN a y USING (i) GROUP BY x.j, y.j), h AS (SELECT x.i, y.j, sum(x.v * y.v) AS v FROM g x JOIN g y ON x.j = y.i GROUP BY x.i, y.j)
    SELECT (SELECT count(DISTINCT i) FROM g)::BIGINT AS directions, round((SELECT ln(sum(v)) FROM g WHERE i = j), 8) AS squares, round((SELECT ln(sum(v * v)) FROM g), 8) AS fourths, round((SELECT ln(sum(g.v * h.v)) FROM g JOIN h USING (i, j)), 8) AS sixths"""
)
def mat_svd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Singular values of the embeddings, by their number and the logarithms of their power sums."""
    wide = table(spark, sf_dir, "embeddings").select(*[F.get("embedding", F.lit(k)).alias(f"x{k}") for k in range(DIMS)])
    values = np.linalg.svd(multivariate.triangular_factor(wide, wide.columns), compute_uv=False)
    return spark.createDataFrame([(len(values), *[round(float(np.log((values**p).sum())), 8) for p in (2, 4, 6)])], "directions long, squares double, fourths double, sixths double")
