"""Queries of clouds, projections, distributions, sampling and optimisation."""

from __future__ import annotations

import math
from itertools import combinations, permutations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import distributions as dist
from tessera.functions import numeric, randoms, special
from tessera.operators import categorical, clusters, crossentropy, multivariate
from tessera.operators.frames import table, with_row_id
from tessera.operators.sampling import UnequalProbabilitySampling

from .registry import plain, query, rounded

_XY = ("l_extendedprice", "l_discount")


def _cloud(spark: SparkSession, sf_dir: str) -> multivariate.Cloud:
    return multivariate.Cloud(table(spark, sf_dir, "lineitem"), _XY, "l_quantity")


@query("SELECT round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) + 0.0 AS x, round(sum(l_quantity * l_discount) / sum(l_quantity), 8) + 0.0 AS y FROM lineitem")
def cloud_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = _cloud(spark, sf_dir).mean()
    return spark.createDataFrame([(float(x), float(y))], "x double, y double").select(plain(F.col("x"), 4).alias("x"), plain(F.col("y"), 8).alias("y"))


_MEANS = "m AS (SELECT sum(l_quantity * l_extendedprice) / sum(l_quantity) AS mx, sum(l_quantity * l_discount) / sum(l_quantity) AS my, sum(l_quantity) AS w FROM lineitem)"
_SECOND = f"WITH {_MEANS}, s AS (SELECT sum(l_quantity * (l_extendedprice - mx) ** 2) / any_value(w) AS sxx, sum(l_quantity * (l_extendedprice - mx) * (l_discount - my)) / any_value(w) AS sxy, sum(l_quantity * (l_discount - my) ** 2) / any_value(w) AS syy FROM lineitem, m)"


@query(f"{_SECOND} SELECT round(sxx, 1) + 0.0 AS xx, round(sxy, 6) + 0.0 AS xy, round(syy, 9) + 0.0 AS yy, round(sxx + syy, 1) + 0.0 AS inertia FROM s")
def cloud_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = _cloud(spark, sf_dir)
    c = cloud.covariance()
    row = spark.createDataFrame([(float(c[0, 0]), float(c[0, 1]), float(c[1, 1]), cloud.variance())], "xx double, xy double, yy double, inertia double")
    return rounded(rounded(rounded(row, 1, ["xx", "inertia"]), 6, ["xy"]), 9, ["yy"])


@query(f"WITH {_MEANS} SELECT l_orderkey, l_partkey, l_linenumber, round(l_extendedprice - mx, 4) + 0.0 AS x, round(l_discount - my, 8) + 0.0 AS y FROM lineitem, m")
def cloud_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _cloud(spark, sf_dir).center().df
    return out.select("l_orderkey", "l_partkey", "l_linenumber", plain(F.col(_XY[0]), 4).alias("x"), plain(F.col(_XY[1]), 8).alias("y"))


@query(f"{_SECOND} SELECT l_orderkey, l_partkey, l_linenumber, round((l_extendedprice - mx) / sqrt(sxx), 6) + 0.0 AS x, round((l_discount - my) / sqrt(syy), 6) + 0.0 AS y FROM lineitem, m, s")
def cloud_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _cloud(spark, sf_dir).standardize().df
    return out.select("l_orderkey", "l_partkey", "l_linenumber", plain(F.col(_XY[0]), 6).alias("x"), plain(F.col(_XY[1]), 6).alias("y"))


_BASIS = np.array([[2.0, 1.0], [0.0, 1.0]])


@query(
    """SELECT p_partkey, round(4 * x * x + 4 * x * y + 2 * y * y, 3) + 0.0 AS squared_norm, round(4 * x * 1 + 2 * x * 2 + 2 * y * 1 + 2 * y * 2, 4) + 0.0 AS product,
    round(sqrt(4 * (x - 1) ** 2 + 4 * (x - 1) * (y - 2) + 2 * (y - 2) ** 2), 4) + 0.0 AS distance, round(2 * x + y, 4) + 0.0 AS v1, round(y, 4) + 0.0 AS v2
    FROM (SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice AS y FROM part)"""
)
def basis_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar products, squared norms, distances and vectors of coordinates in a basis."""
    basis, x = multivariate.Basis(_BASIS), [F.col("p_size").cast("double"), F.col("p_retailprice")]
    at = [F.lit(1.0), F.lit(2.0)]
    v1, v2 = basis.vectors(x)
    out = table(spark, sf_dir, "part").select(
        "p_partkey", plain(basis.squared_norm(x), 3).alias("squared_norm"), plain(basis.scalar_product(x, at), 4).alias("product"),
        plain(basis.distance(x, at), 4).alias("distance"), plain(v1, 4).alias("v1"), plain(v2, 4).alias("v2"),
    )
    return out


@query("SELECT p_partkey, round((2 * x + y) / 4, 6) + 0.0 AS a, round(y / 5, 6) + 0.0 AS b FROM (SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice AS y FROM part)")
def basis_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same vectors in another basis."""
    a, b = multivariate.Basis(_BASIS).change_coordinates([F.col("p_size").cast("double"), F.col("p_retailprice")], multivariate.Basis(np.diag([4.0, 5.0])))
    return table(spark, sf_dir, "part").select("p_partkey", plain(a, 6).alias("a"), plain(b, 6).alias("b"))


_PCA = """WITH c AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS d FROM (SELECT p_size::DOUBLE AS x, p_retailprice AS y FROM part)),
e AS (SELECT *, (a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b * b) AS l1, (a + d) / 2 - sqrt(((a - d) / 2) ** 2 + b * b) AS l2 FROM c)"""


@query(f"{_PCA} SELECT round(l1, 3) + 0.0 AS first, round(l2, 4) + 0.0 AS second FROM e")
def pca_variances(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = multivariate.principal_components(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"])
    row = spark.createDataFrame([tuple(map(float, p.variances))], "first double, second double")
    return rounded(rounded(row, 3, ["first"]), 4, ["second"])


@query(
    f"""{_PCA}, v AS (SELECT *, b / sqrt(b * b + (l1 - a) ** 2) AS ux, (l1 - a) / sqrt(b * b + (l1 - a) ** 2) AS uy FROM e), s AS (SELECT *, CASE WHEN uy < 0 THEN -1 ELSE 1 END AS g, CASE WHEN uy < 0 THEN uy ELSE -uy END AS wx FROM v)
    SELECT p_partkey, round(g * ((p_size - mx) * ux + (p_retailprice - my) * uy), 5) + 0.0 AS pc1, round(abs((p_size - mx) * uy - (p_retailprice - my) * ux), 5) + 0.0 AS pc2 FROM part, s"""
)
def pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of parts; the second up to its sign."""
    p = multivariate.principal_components(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"])
    return p.coordinates().select("p_partkey", plain(F.col("pc1"), 5).alias("pc1"), plain(F.abs("pc2"), 5).alias("pc2"))


@query(
    """WITH z AS (SELECT p_partkey, 2 * p_size::DOUBLE AS x, 0.1 * p_retailprice AS y FROM part), c AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS d FROM z),
    e AS (SELECT *, (a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b * b) AS l1, (a + d) / 2 - sqrt(((a - d) / 2) ** 2 + b * b) AS l2 FROM c),
    v AS (SELECT *, b / sqrt(b * b + (l1 - a) ** 2) AS ux, (l1 - a) / sqrt(b * b + (l1 - a) ** 2) AS uy FROM e),
    s AS (SELECT p_partkey, n, l1, l2, ((x - mx) * ux + (y - my) * uy) ** 2 AS s1, ((x - mx) * uy - (y - my) * ux) ** 2 AS s2 FROM z, v)
    SELECT p_partkey, round(1e4 * s1 / n / l1, 6) + 0.0 AS contribution1, round(1e4 * s2 / n / l2, 6) + 0.0 AS contribution2, round(s1 / (s1 + s2), 6) + 0.0 AS quality1, round(s2 / (s1 + s2), 6) + 0.0 AS quality2 FROM s"""
)
def pca_qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions (in ten thousandths) and representation qualities of the parts, under weighed variables."""
    p = multivariate.principal_components(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"], coefficients=[4.0, 0.01])
    c = p.contributions().select("p_partkey", *[plain(1e4 * F.col(f"contribution{k}"), 6).alias(f"contribution{k}") for k in (1, 2)])
    q = p.representation_qualities().select("p_partkey", *[plain(F.col(f"quality{k}"), 6).alias(f"quality{k}") for k in (1, 2)])
    return c.join(q, "p_partkey")


def _axes_sql(rows: str, columns: str, source: str) -> str:
    """The first two axes of a correspondence of two variables (tables axes1, axes2: sigma, vector v over row categories;
    standard scores: rows1, rows2 (r, a), columns1, columns2 (c, b)), by power iterations on the row categories."""
    def axis(k: int, against: str) -> str:
        start = "list_transform(range(1, len(m) + 1), lambda i: sin(i * 1.7) + 0.3 * i)"
        project = lambda v: f"list_transform({v}, lambda x, i: x - list_inner_product({v}, o) * o[i])" if against else v
        unit = lambda v: f"list_transform({v}, lambda x: x / sqrt(list_inner_product({v}, {v})))"
        o = f", (SELECT v FROM axes{k - 1}) AS o" if against else ""
        step = "list_transform(range(1, len(m) + 1), lambda i: list_inner_product(m[i], v))"
        return f"""
        it{k} AS (SELECT 0 AS t, m, {unit("v0")} AS v FROM (SELECT m, {project("v0")} AS v0 FROM (SELECT m, {start} AS v0{o} FROM big))
          UNION ALL SELECT t + 1, m, {unit("v1")} FROM (SELECT t, m, {project("v1")} AS v1 FROM (SELECT t, m, {step} AS v1{o} FROM it{k})) WHERE t < 400),
        axes{k} AS (SELECT v, sqrt(list_inner_product(v, list_transform(range(1, len(s) + 1), lambda i: list_inner_product(s[i], v)))) AS sigma FROM it{k}, small WHERE t = 400),
        rows{k} AS (SELECT r, v[ri] / sqrt(pr) AS a FROM rs, axes{k}),
        columns{k} AS (SELECT c, sum(p * a) / any_value(pc) / any_value(sigma) AS b FROM p JOIN rows{k} USING (r), axes{k} GROUP BY c)"""
    return f"""t AS (SELECT {rows} AS r, {columns} AS c, count(*)::DOUBLE AS n FROM {source} GROUP BY 1, 2), g AS (SELECT sum(n) AS n FROM t),
    rs AS (SELECT r, sum(t.n) / any_value(g.n) AS pr, row_number() OVER (ORDER BY r) AS ri FROM t, g GROUP BY r), cs AS (SELECT c, sum(t.n) / any_value(g.n) AS pc FROM t, g GROUP BY c),
    p AS (SELECT rs.r, ri, pr, cs.c, pc, coalesce(t.n, 0) / g.n AS p FROM rs CROSS JOIN cs CROSS JOIN g LEFT JOIN t ON t.r = rs.r AND t.c = cs.c),
    k AS (SELECT x.ri AS i, y.ri AS j, sum((x.p - x.pr * x.pc) * (y.p - y.pr * y.pc) / x.pc) / sqrt(any_value(x.pr) * any_value(y.pr)) AS v FROM p x JOIN p y USING (c) GROUP BY 1, 2),
    small AS (SELECT list(l ORDER BY i) AS s FROM (SELECT i, list(v ORDER BY j) AS l FROM k GROUP BY i)),
    k2 AS (SELECT x.i, y.j, sum(x.v * y.v) AS v FROM k x JOIN k y ON x.j = y.i GROUP BY 1, 2), k4 AS (SELECT x.i, y.j, sum(x.v * y.v) AS v FROM k2 x JOIN k2 y ON x.j = y.i GROUP BY 1, 2),
    scaled AS (SELECT i, j, v / (SELECT max(abs(v)) FROM k4) AS v FROM k4),
    big AS (SELECT list(l ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS l FROM scaled GROUP BY i)), {axis(1, "")}, {axis(2, "1")}"""


@query(
    """WITH t AS (SELECT c_mktsegment AS r, n_regionkey AS c, count(*)::DOUBLE AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2), g AS (SELECT sum(n) AS n FROM t),
    p AS (SELECT a.r, b.c, coalesce(t.n, 0) / g.n AS p, a.n / g.n AS pr, b.n / g.n AS pc FROM (SELECT r, sum(n) AS n FROM t GROUP BY r) a CROSS JOIN (SELECT c, sum(n) AS n FROM t GROUP BY c) b CROSS JOIN g LEFT JOIN t ON t.r = a.r AND t.c = b.c)
    SELECT round(sum((p - pr * pc) ** 2 / (pr * pc)), 9) + 0.0 AS inertia FROM p"""
)
def ca_inertia(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variances of a correspondence analysis sum to the table's chi-squared over n."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    cells = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("c_mktsegment", "n_regionkey").agg(F.count(F.lit(1)).alias("n"))
    found = multivariate.correspondence(cells, "c_mktsegment", "n_regionkey", "n")
    return spark.createDataFrame([(float(found.variances.sum()),)], "inertia double").select(plain(F.col("inertia"), 9).alias("inertia"))


_SEGMENTS = _axes_sql("c_mktsegment", "n_regionkey", "customer JOIN nation ON c_nationkey = n_nationkey")


@query(f"WITH RECURSIVE {_SEGMENTS} SELECT r AS category, round(abs(a * sigma), 6) + 0.0 AS score FROM rows1, axes1 UNION ALL SELECT 'region ' || c, round(abs(b * sigma), 6) + 0.0 FROM columns1, axes1")
def ca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments' and regions' coordinates on the first axis, up to their sign."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    cells = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("c_mktsegment", "n_regionkey").agg(F.count(F.lit(1)).alias("n"))
    counts, rows, cols = multivariate.contingency_array(cells, "c_mktsegment", "n_regionkey", "n")
    found = multivariate.correspondence_of(counts)
    listed = [*zip(rows, found.row_coordinates[:, 0], strict=True), *zip([f"region {c}" for c in cols], found.column_coordinates[:, 0], strict=True)]
    return spark.createDataFrame([(k, abs(float(v))) for k, v in listed], "category string, score double").select("category", plain(F.col("score"), 6).alias("score"))


_NATIONS = _axes_sql("c_mktsegment", "c_nationkey", "customer")


@query(f"WITH RECURSIVE {_NATIONS} SELECT c_custkey AS row_id, round(abs(x.a + y.b) / 2, 5) + 0.0 AS factor1, round(abs(u.a + w.b) / 2, 5) + 0.0 AS factor2 FROM customer JOIN rows1 x ON x.r = c_mktsegment JOIN columns1 y ON y.c = c_nationkey JOIN rows2 u ON u.r = c_mktsegment JOIN columns2 w ON w.c = c_nationkey")
def mca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Individuals of a multiple correspondence analysis, up to the factors' signs."""
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").cast("string").alias("nation"))
    found = multivariate.multiple_correspondence(categorical.encode(df, "c_custkey", ["c_mktsegment", "nation"]))
    return found.individuals().select("row_id", *[plain(F.abs(f"factor{k}"), 5).alias(f"factor{k}") for k in (1, 2)])


_MDS = "q AS (SELECT a.s_suppkey AS i, b.s_suppkey AS j, (a.s_acctbal - b.s_acctbal) ** 2 + (a.s_nationkey - b.s_nationkey) ** 2 AS q FROM supplier a, supplier b)"


@query(f"WITH {_MDS} SELECT i, j, round((-0.5 * (q - avg(q) OVER (PARTITION BY i) - avg(q) OVER (PARTITION BY j) + avg(q) OVER ())) / 1e6, 6) + 0.0 AS v FROM q")
def mds_double_centering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounded as SQL has it, by whole millionths: decimals would take longer than all the rest."""
    out = multivariate.double_centered_distances(table(spark, sf_dir, "supplier"), "s_suppkey", ["s_acctbal", "s_nationkey"])
    v = F.col("v") / 1e6
    return out.select("i", "j", (F.signum(v) * F.floor(F.abs(v) * 1e6 + 0.5) / 1e6 + 0.0).alias("v"))


def _supplier_proximities(spark: SparkSession, sf_dir: str) -> multivariate.Proximities:
    return multivariate.Proximities.of_points(table(spark, sf_dir, "supplier"), "s_suppkey", ["s_acctbal", "s_nationkey"])


_PLANE = """WITH z AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS point, s_acctbal AS x, s_nationkey::DOUBLE AS y FROM supplier), c AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS d FROM z),
e AS (SELECT *, (a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b * b) AS l1, (a * d - b * b) / ((a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b * b)) AS l2 FROM c), v AS (SELECT *, (l1 - d) / sqrt(b * b + (l1 - d) ** 2) AS ux, b / sqrt(b * b + (l1 - d) ** 2) AS uy FROM e),
s AS (SELECT point::INTEGER AS point, l1, l2, abs((x - mx) * ux + (y - my) * uy) AS s1, abs((x - mx) * uy - (y - my) * ux) AS s2 FROM z, v)"""


@query(f"{_PLANE} SELECT point, round(s1, 4) + 0.0 AS x, round(l1 / (l1 + l2), 6) + 0.0 AS fit FROM s")
def mds_classical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers on a line, up to its direction: points of a plane come back as their first principal scores."""
    found = multivariate.classical_scaling_of(_supplier_proximities(spark, sf_dir), 1)
    out = spark.createDataFrame([(k, abs(float(x)), found.fit) for k, (x,) in enumerate(found.configuration)], "point int, x double, fit double")
    return rounded(rounded(out, 4, ["x"]), 6, ["fit"])


@query(f"{_PLANE} SELECT point, round(s1 / sqrt(l1 + l2), 4) + 0.0 AS x, round(s2 / sqrt(l1 + l2), 4) + 0.0 AS y, 0.0::DOUBLE AS stress FROM s")
def mds_non_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in a plane, up to its directions: no stress is left, and the mean square is 1."""
    found = multivariate.non_metric_scaling_of(_supplier_proximities(spark, sf_dir), 2)
    out = spark.createDataFrame([(k, abs(float(x)), abs(float(y)), found.fit) for k, (x, y) in enumerate(found.configuration)], "point int, x double, y double, stress double")
    return rounded(out, 4)


_FOUR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _minors(size: int) -> str:
    """The sum of all principal minors of the covariance matrix, as SQL."""
    sign = lambda p: (-1) ** sum(p[i] > p[j] for i in range(len(p)) for j in range(i + 1, len(p)))
    cell = lambda i, j: f"m{min(i, j)}{max(i, j)}"
    terms = [f"{'+' if sign(p) > 0 else '-'} {' * '.join(cell(chosen[i], chosen[k]) for i, k in enumerate(p))}" for chosen in combinations(range(4), size) for p in permutations(range(size))]
    return " ".join(terms)


@query(
    "WITH c AS (SELECT " + ", ".join(f"covar_pop({_FOUR[i]}, {_FOUR[j]}) AS m{i}{j}" for i in range(4) for j in range(i, 4)) + " FROM lineitem) "
    + " UNION ALL ".join(f"SELECT {k} AS k, round(ln({_minors(k)}), 6) + 0.0 AS value FROM c" for k in range(1, 5))
)
def spectral_eigenvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four eigenvalues, by the logarithms of their elementary symmetric functions: the sums of principal minors."""
    c = multivariate.Cloud(table(spark, sf_dir, "lineitem"), _FOUR).covariance()
    values, _ = multivariate.spectral_decomposition(c)
    sums = [sum(np.prod(x) for x in combinations(values, k)) for k in range(1, 5)]
    return spark.createDataFrame([(k, float(np.log(v))) for k, v in enumerate(sums, 1)], "k int, value double").select("k", plain(F.col("value"), 6).alias("value"))


@query(
    """WITH z AS (SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice AS y FROM part), c AS (SELECT sum(x * x) AS a, sum(x * y) AS b, sum(y * y) AS d FROM z),
    e AS (SELECT *, (a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b * b) AS l1 FROM c), v AS (SELECT *, (a * d - b * b) / l1 AS l2, b / sqrt(b * b + (l1 - a) ** 2) AS ux, (l1 - a) / sqrt(b * b + (l1 - a) ** 2) AS uy FROM e)
    SELECT p_partkey, round(100 * (x * ux + y * uy) / sqrt(l1), 6) + 0.0 AS u1, round(100 * (x * uy - y * ux) / sqrt(l2), 6) + 0.0 AS u2 FROM z, v"""
)
def svd_tall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left singular vectors of a tall frame as columns, in hundredths."""
    out, _, _ = multivariate.tall_svd(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"])
    return out.select("p_partkey", plain(100 * F.col("u1"), 6).alias("u1"), plain(100 * F.col("u2"), 6).alias("u2"))


_TOTAL = "o_totalprice / 123457.0"


def _distribution(name: str, make: dist.Distribution, sql_pdf: str, sql_cdf: str, sql_inverse: str | None):  # noqa: ANN202
    inverse = f", round({sql_inverse.replace('$', '(o_totalprice / 1234577.0)')}, 6) + 0.0 AS inverse" if sql_inverse else ""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        z, p = F.col("o_totalprice") / 123457.0, F.col("o_totalprice") / 1234577.0
        cells = [plain(make.pdf(z), 6).alias("pdf"), plain(make.cdf(z), 6).alias("cdf")]
        if sql_inverse:
            cells.append(plain(make.inverse_cdf(p), 6).alias("inverse"))
        return table(spark, sf_dir, "orders").select("o_orderkey", *cells)

    run.__name__ = f"dist_{name}"
    query(f"SELECT o_orderkey, round({sql_pdf.replace('$', _TOTAL)}, 6) + 0.0 AS pdf, round({sql_cdf.replace('$', _TOTAL)}, 6) + 0.0 AS cdf{inverse} FROM orders")(run)


_distribution("exponential", dist.Exponential(0.7), "0.7 * exp(-0.7 * ($))", "1 - exp(-0.7 * ($))", "-ln(1 - $) / 0.7")
_distribution("uniform", dist.Uniform(0.5, 3.5), "CASE WHEN $ BETWEEN 0.5 AND 3.5 THEN 1.0 / 3 ELSE 0.0 END::DOUBLE", "CASE WHEN $ <= 0.5 THEN 0.0 WHEN $ >= 3.5 THEN 1.0 ELSE ($ - 0.5) / 3 END::DOUBLE", "0.5 + $ * 3.0")
_distribution("pareto_heavy", dist.GeneralizedPareto(0.0, 2.0, 0.4), "pow(1 + 0.2 * ($), -3.5) / 2", "1 - pow(1 + 0.2 * ($), -2.5)", "2 * (pow(1 - $, -0.4) - 1) / 0.4")
_distribution("pareto_light", dist.GeneralizedPareto(0.0, 2.0, 0.0), "exp(-($) / 2) / 2", "1 - exp(-($) / 2)", "-2 * ln(1 - $)")
_distribution("pareto_short", dist.GeneralizedPareto(0.0, 2.0, -0.5), "CASE WHEN $ > 4 THEN 0.0 ELSE pow(greatest(1 - 0.25 * ($), 0), 1.0) / 2 END::DOUBLE", "CASE WHEN $ >= 4 THEN 1.0 ELSE 1 - pow(greatest(1 - 0.25 * ($), 0), 2.0) END::DOUBLE", "2 * (pow(1 - $, 0.5) - 1) / -0.5")


@query("SELECT l_orderkey, l_partkey, l_linenumber, round(CASE WHEN l_linenumber = 0 THEN 0.7 WHEN l_linenumber = 1 THEN 0.3 ELSE 0 END::DOUBLE, 6) + 0.0 AS pdf, round(CASE WHEN l_linenumber < 0 THEN 0 WHEN l_linenumber < 1 THEN 0.7 ELSE 1 END::DOUBLE, 6) + 0.0 AS cdf FROM lineitem")
def dist_bernoulli(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, x = dist.Bernoulli(0.3), F.col("l_linenumber").cast("double")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", plain(d.pdf(x), 6).alias("pdf"), plain(d.cdf(x), 6).alias("cdf"))


@query("SELECT l_orderkey, l_partkey, l_linenumber, round(CASE l_linenumber WHEN 1 THEN 0.5 WHEN 3 THEN 0.2 WHEN 4 THEN 0.3 ELSE 0 END::DOUBLE, 6) + 0.0 AS pdf, round((CASE WHEN l_linenumber >= 1 THEN 0.5 ELSE 0 END + CASE WHEN l_linenumber >= 3 THEN 0.2 ELSE 0 END + CASE WHEN l_linenumber >= 4 THEN 0.3 ELSE 0 END)::DOUBLE, 6) + 0.0 AS cdf FROM lineitem")
def dist_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, x = dist.FiniteDiscrete((1.0, 3.0, 4.0), (0.5, 0.2, 0.3)), F.col("l_linenumber").cast("double")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", plain(d.pdf(x), 6).alias("pdf"), plain(d.cdf(x), 6).alias("cdf"))


@query("SELECT p_partkey, round(exp(-0.5 * ((p_retailprice - 1400) / 300) ** 2) / (300 * sqrt(2 * pi())), 9) + 0.0 AS pdf FROM part")
def dist_gaussian_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", plain(dist.Gaussian(1400.0, 300.0).pdf(F.col("p_retailprice")), 9).alias("pdf"))


@query(
    """WITH w AS (SELECT p_partkey, (p_retailprice - 1400) / 400 AS z FROM part), n AS (SELECT k, CASE WHEN k = 0 OR k = 1000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END AS f FROM range(1001) t(k))
    SELECT p_partkey, round(any_value(0.5 + z / 3000 * s), 9) + 0.0 AS cdf, round(any_value(1400 + 400 * z), 4) + 0.0 AS back FROM (SELECT p_partkey, z, sum(f * exp(-0.5 * (z * k / 1000) ** 2)) / sqrt(2 * pi()) AS s FROM w, n GROUP BY p_partkey, z) GROUP BY p_partkey"""
)
def dist_gaussian_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distribution function, by Simpson's rule in SQL, and the price that its inverse gives back."""
    d = dist.Gaussian(1400.0, 400.0)
    found = table(spark, sf_dir, "part").select("p_partkey", d.cdf(F.col("p_retailprice")).alias("p"))
    return found.select("p_partkey", plain(F.col("p"), 9).alias("cdf"), plain(d.inverse_cdf(F.col("p")), 4).alias("back"))


@query("SELECT p_partkey, round(lgamma(p_size + 0.5), 9) + 0.0 AS log_gamma, round(ln(gamma(p_size + 1.0)), 9) + 0.0 AS log_factorial FROM part")
def special_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", plain(special.log_gamma(n + 0.5), 9).alias("log_gamma"), plain(F.log(special.factorial(n)), 9).alias("log_factorial"))


@query("SELECT k::BIGINT AS k, floor(round(exp(lgamma(51) - lgamma(k + 1) - lgamma(51 - k)), 0) / 1e6)::BIGINT AS millions FROM range(51) t(k)")
def special_binomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binomial coefficients of 50, in whole millions."""
    return spark.range(51).select(F.col("id").alias("k"), F.floor(special.binomial(F.lit(50), F.col("id")) / 1e6).alias("millions"))


@query("SELECT count(*)::BIGINT AS n, 0::BIGINT AS first, max(o_orderkey) IS NOT NULL AS whole, count(DISTINCT o_orderkey)::BIGINT AS keys FROM orders")
def sample_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random permutation takes each position once."""
    out = randoms.permutation(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", seed=4)
    return out.agg(F.countDistinct("position").alias("n"), F.min("position").alias("first"), (F.max("position") == F.count(F.lit(1)) - 1).alias("whole"), F.countDistinct("o_orderkey").alias("keys"))


@query("SELECT least(50, count(*))::BIGINT AS n, least(50, count(*))::BIGINT AS keys, 0::BIGINT AS strangers FROM supplier")
def sample_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "supplier")
    drawn = randoms.simple_sample(df, "s_suppkey", min(50, df.count()), seed=9)
    known = df.select("s_suppkey", F.lit(1).alias("known"))
    return drawn.join(known, "s_suppkey", "left").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("s_suppkey").alias("keys"), F.count(F.when(F.col("known").isNull(), 1)).alias("strangers"))


_SYMMETRIC = "list_transform(range(1, 7), lambda k: e[k] + CASE WHEN k > 1 THEN w * e[k - 1] ELSE 0 END)"


@query(
    f"""WITH RECURSIVE u AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier), q AS (SELECT i, n, 0.1 + 0.8 * i / (n - 1) AS p FROM u), x AS (SELECT i, n, p / (1 - p) AS w FROM q),
    s AS (SELECT o.i AS left_out, -1::BIGINT AS i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]::DOUBLE[] AS e FROM (SELECT i FROM x UNION ALL SELECT -1) o
      UNION ALL SELECT s.left_out, x.i, CASE WHEN x.i = s.left_out THEN s.e ELSE {_SYMMETRIC.replace('e[', 's.e[').replace('w *', 'x.w *')} END FROM s JOIN x ON x.i = s.i + 1),
    f AS (SELECT left_out, e FROM s WHERE i = (SELECT max(i) FROM x))
    SELECT x.i AS i, round(w * f.e[5] / (SELECT e[6] FROM f WHERE left_out = -1), 8) + 0.0 AS inclusion, 5::BIGINT AS n FROM x JOIN f ON f.left_out = x.i"""
)
def sample_unequal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' probabilities to be among five drawn with unequal probabilities, and how many are drawn."""
    df = with_row_id(table(spark, sf_dir, "supplier").select("s_suppkey"), ["s_suppkey"], "i")
    design = UnequalProbabilitySampling.from_bernoulli(np.linspace(0.1, 0.9, df.count()), 5)
    drawn = design.sample(df, "i", np.random.default_rng(2)).count()
    return spark.createDataFrame([(k, float(p), drawn) for k, p in enumerate(design.inclusion_probabilities())], "i long, inclusion double, n long").select("i", plain(F.col("inclusion"), 8).alias("inclusion"), "n")


_LINE = "WITH z AS (SELECT p_size / 25.0 AS x, p_retailprice / 1000 AS y FROM part)"


@query(f"{_LINE} SELECT 'intercept' AS argument, round(regr_intercept(y, x), 2) + 0.0 AS optimum FROM z UNION ALL SELECT 'slope', round(regr_slope(y, x), 2) + 0.0 FROM z")
def ce_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of least squares through sizes and prices, by cross-entropy."""
    s = _squares(spark, sf_dir)
    found = crossentropy.minimize(lambda a: _loss(a[0], a[1], s), np.zeros(2), seed=1)
    return spark.createDataFrame([(k, round(float(v), 2) + 0.0) for k, v in zip(("intercept", "slope"), found, strict=True)], "argument string, optimum double")


def _squares(spark: SparkSession, sf_dir: str):  # noqa: ANN202
    """Mean products of sizes and prices, in one pass."""
    x, y = F.col("p_size") / 25.0, F.col("p_retailprice") / 1000
    return table(spark, sf_dir, "part").agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.avg(x * x).alias("xx"), F.avg(x * y).alias("xy"), F.avg(y * y).alias("yy")).first()


def _loss(a, b, s):  # noqa: ANN001, ANN202
    """The mean square of y - a - b x."""
    return s.yy + a * a + b * b * s.xx - 2 * a * s.y - 2 * b * s.xy + 2 * a * b * s.x


@query("SELECT round(1e9 * 221 * exp(-20), 3) + 0.0 AS billionths, true AS near")
def ce_rare_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P(sum of three exponentials > 20), estimated on the executors, lies within 5 % of the exact value."""
    context = crossentropy.RareEvent(
        lambda s: s.sum(axis=1),
        lambda rng, p, n: rng.exponential(p, (n, len(p))),
        lambda s, u, v: np.exp((s * (1 / v - 1 / u)).sum(axis=1)) * np.prod(v / u),
        np.ones(3), 20.0,
    )
    found = crossentropy.rare_event_probability(context, 2000, 0.1, 100_000, seed=3, spark=spark)
    exact = 221 * math.exp(-20)
    return spark.createDataFrame([(round(1e9 * exact, 3), abs(found.extra["probability"] / exact - 1) < 0.05)], "billionths double, near boolean")


@query(
    """WITH g AS (SELECT c_nationkey, avg(c_acctbal) AS a, count(*)::DOUBLE AS n FROM customer GROUP BY 1), z AS (SELECT (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS x, (n - avg(n) OVER ()) / stddev_pop(n) OVER () AS y, ntile(3) OVER (ORDER BY a, c_nationkey) AS t FROM g)
    SELECT count(*)::BIGINT AS nations, 3::BIGINT AS parts, true AS better, round((SELECT sum(s) FROM (SELECT var_pop(x) * count(*) + var_pop(y) * count(*) AS s FROM z GROUP BY t)), 6) + 0.0 AS thirds FROM z"""
)
def clusters_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' mean accounts and customers in three clusters, of less scatter than thirds by account."""
    held = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("a"), F.count(F.lit(1)).alias("n")).orderBy("a", "c_nationkey").collect()
    points = np.array([[r.a, r.n] for r in held], float)
    points = (points - points.mean(axis=0)) / points.std(axis=0)
    parts = clusters.discover(points, 3, seed=5)
    scatter = lambda labels: float(sum(((points[labels == p] - points[labels == p].mean(axis=0)) ** 2).sum() for p in set(labels.tolist())))
    sizes = [len(held) // 3 + (k < len(held) % 3) for k in range(3)]
    thirds = scatter(np.repeat(np.arange(3), sizes))
    return spark.createDataFrame([(len(parts), len(set(parts.tolist())), scatter(parts) < thirds, round(thirds, 6))], "nations long, parts long, better boolean, thirds double")


@query(
    """WITH e AS (SELECT vec_id, label, unnest(range(64))::INTEGER AS j, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT label, j, avg(v) AS m FROM e GROUP BY label, j),
    q AS (SELECT vec_id, e.label, e.j, (v - m) ** 2 AS q FROM e JOIN m USING (label, j)), s AS (SELECT a.label, a.j AS i, b.j AS j, avg(sqrt(a.q + b.q)) AS s FROM q a JOIN q b ON a.vec_id = b.vec_id AND a.j < b.j GROUP BY 1, 2, 3),
    d AS (SELECT x.j AS i, y.j AS j, x.label AS a, z.label AS b, sqrt((x.m - z.m) ** 2 + (y.m - w.m) ** 2) AS d FROM m x JOIN m y ON x.label = y.label AND x.j < y.j JOIN m z ON z.j = x.j AND z.label <> x.label JOIN m w ON w.label = z.label AND w.j = y.j),
    r AS (SELECT d.i, d.j, d.a, max((u.s + v.s) / d) AS r FROM d JOIN s u ON u.label = d.a AND u.i = d.i AND u.j = d.j JOIN s v ON v.label = d.b AND v.i = d.i AND v.j = d.j GROUP BY 1, 2, 3),
    best AS (SELECT i, j FROM r GROUP BY i, j ORDER BY avg(r), i, j LIMIT 1) SELECT i AS component FROM best UNION ALL SELECT j FROM best"""
)
def clusters_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two embedding components that part the labels best."""
    found = clusters.explain_table(table(spark, sf_dir, "embeddings"), "embedding", "label", 2)
    return spark.createDataFrame([(int(k),) for k in found], "component int")


@query(f"{_LINE} SELECT 'intercept' AS argument, round(2 * 0.5 + 2 * 0.25 * avg(x) - 2 * avg(y), 6) + 0.0 AS gradient, 2.0::DOUBLE AS curvature FROM z UNION ALL SELECT 'slope', round(2 * 0.25 * avg(x * x) + 2 * 0.5 * avg(x) - 2 * avg(x * y), 6) + 0.0, round(2 * avg(x * x), 3) + 0.0 FROM z")
def numeric_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient and second derivatives of the squared error of the line 1/2 + x/4 through sizes and prices."""
    s = _squares(spark, sf_dir)
    f = lambda a: _loss(a[0], a[1], s)
    at = np.array([0.5, 0.25])
    g, h = numeric.gradient(f, at), numeric.hessian(f, at)
    out = spark.createDataFrame([(name, float(g[k]), float(h[k, k])) for k, name in enumerate(("intercept", "slope"))], "argument string, gradient double, curvature double")
    return rounded(rounded(out, 6, ["gradient"]), 3, ["curvature"])
