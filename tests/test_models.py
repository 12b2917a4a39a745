"""Clouds, scaling, distributions, sampling, optimisation, streams."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import distributions as dist
from tessera.functions import numeric, randoms, special
from tessera.operators import clusters, crossentropy, multivariate
from tessera.operators.categorical import encode
from tessera.operators.sampling import UnequalProbabilitySampling


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3)) @ np.array([[2.0, 0.5, 0], [0, 1, 0.3], [0, 0, 0.2]]) + 5
    w = rng.random(60)
    w = w / w.sum()
    df = spark.createDataFrame([(k, *map(float, r), float(v)) for k, (r, v) in enumerate(zip(x, w, strict=True))], "id long, a double, b double, c double, w double")
    return x, w, df


def test_cloud(points):
    x, w, df = points
    basis = multivariate.Basis(np.diag([1.0, 2.0, 3.0]))
    cloud = multivariate.Cloud(df, ("a", "b", "c"), "w", basis)
    cloud.validate()
    mean = w @ x
    cov = (x - mean).T @ np.diag(w) @ (x - mean)
    assert np.allclose(cloud.mean(), mean) and np.allclose(cloud.covariance(), cov)
    assert cloud.variance() == pytest.approx(np.trace(cov @ basis.products))
    assert np.allclose(cloud.center().mean(), 0) and np.allclose(np.diag(cloud.standardize().covariance()), 1)
    with pytest.raises(ValueError):
        multivariate.Cloud(df.withColumn("w", F.col("w") * 2), ("a",), "w").validate()
    with pytest.raises(ValueError):
        multivariate.Basis(np.ones((2, 2)))


def test_projections_follow_the_weighted_svd(points):
    x, w, df = points
    a = np.diag([3.0, 2.0, 1.0])
    p = multivariate.Cloud(df, ("a", "b", "c"), "w", multivariate.Basis(a)).principal_projections()
    y = (x - w @ x) @ a.T
    u, s, vt = np.linalg.svd(np.sqrt(w)[:, None] * y, full_matrices=False)
    assert np.allclose(p.variances, s**2)
    scores = np.array([r[-3:] for r in p.coordinates().orderBy("id").collect()], float)
    assert np.allclose(np.abs(scores), np.abs(y @ vt.T))
    assert np.allclose(np.abs(p.directions), np.abs(np.linalg.inv(a) @ vt.T))
    assert np.allclose(p.regress_supplementary_variables(["a", "b", "c"]), p.regression_coefficients)
    assert np.allclose(p.correlate_supplementary_variables(["a", "b", "c"]), p.correlations)
    quality = p.representation_qualities().select(sum(F.col(f"quality{k}") for k in (1, 2, 3))).collect()
    assert np.allclose([r[0] for r in quality], 1)
    assert p.contributions().agg(F.sum("contribution2")).first()[0] == pytest.approx(1)


def test_correspondence_and_multiple_correspondence(spark):
    table = np.array([[10.0, 2, 3], [4, 8, 1], [2, 3, 9]])
    found = multivariate.correspondence_of(table)
    p = table / table.sum()
    e = np.outer(p.sum(1), p.sum(0))
    assert found.variances.sum() == pytest.approx(((p - e) ** 2 / e).sum())
    assert np.allclose(found.row_weights @ found.row_coordinates, 0)
    with pytest.raises(ValueError):
        multivariate.correspondence_of(np.array([[1.0, 0], [1, 0]]))
    rng = np.random.default_rng(2)
    rows = [(k, "abc"[rng.integers(3)], "xy"[rng.integers(2)]) for k in range(80)]
    data = encode(spark.createDataFrame(rows, "id long, u string, v string"), "id", ["u", "v"])
    mca = multivariate.multiple_correspondence(data)
    z = np.array([r[1:] for r in data.disjoin().orderBy("row_id").collect()], float)
    full = multivariate.correspondence_of(z)
    assert np.allclose(mca.variances, full.variances[: len(mca.variances)])
    mine = np.array([[r.factor1, r.factor2] for r in mca.individuals().orderBy("row_id").collect()])
    assert np.allclose(np.abs(mine), np.abs(full.row_coordinates[:, :2]))


def test_scaling():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(12, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    found = multivariate.classical_scaling(d)
    y = found.configuration
    assert y.shape == (12, 2) and found.fit == pytest.approx(1)
    assert np.allclose(np.sqrt(((y[:, None] - y[None]) ** 2).sum(axis=2)), d)
    assert multivariate.non_metric_scaling(d**3, 2).fit < 0.05
    with pytest.raises(ValueError):
        multivariate.classical_scaling(d, 5)
    with pytest.raises(ValueError):
        multivariate.classical_scaling(np.array([[0.0, 1], [2, 0]]))
    fitted = multivariate.monotone_fit(np.array([0, 1, 2, 3]), np.array([1.0, 3, 2, 4]), np.array([1.0, 2, 3, 4]))
    assert fitted.tolist() == [1, 2.5, 2.5, 4]


def _copies(spark, sf_dir, times, folder):
    """Suppliers of an sf, repeated with shifted keys."""
    df = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    n = df.count()
    out = df.crossJoin(spark.range(times)).select((F.col("s_suppkey") + F.col("id") * n).alias("s_suppkey"), "s_name", "s_nationkey", "s_acctbal")
    out.coalesce(1).write.parquet(f"{folder}/supplier.parquet")
    return str(folder)


def _as_sql(name, spark, sf_dir):
    """The query's rows and DuckDB's, in order."""
    import duckdb

    from tessera.plans import catalogue

    db = duckdb.connect()
    db.sql(f"CREATE VIEW supplier AS SELECT * FROM '{sf_dir}/supplier.parquet/*.parquet'")
    mine = catalogue.queries()[name](spark, sf_dir)
    sql = db.sql(f"SELECT {', '.join(mine.columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    return sorted(tuple(r) for r in mine.collect()), sorted(sql)


@pytest.mark.parametrize("name", ["mds_classical", "mds_non_metric"])
def test_more_points_than_the_driver_squares_are_scaled(spark, tmp_path, name):
    mine, sql = _as_sql(name, spark, _copies(spark, "/root/testdata/sf0.1", 5, tmp_path))
    assert len(mine) == 5000 > multivariate.SCALING_POINTS and mine == sql


def test_double_centring_shuffles_no_pairs(spark):
    x = np.random.default_rng(9).normal(size=(20, 2))
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "id long, a double, b double")
    q = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    c = np.eye(20) - 1 / 20
    d = spark.createDataFrame([(i, j, float(np.sqrt(q[i, j]))) for i in range(20) for j in range(20)], "i long, j long, v double")
    for out in (multivariate.double_centered_distances(df, "id", ["a", "b"]), multivariate.double_centered(d)):
        found = np.zeros((20, 20))
        for r in out.collect():
            found[r.i, r.j] = r.v
        assert np.allclose(found, -0.5 * c @ q @ c)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "hashpartitioning" not in plan
    lost = df.unionByName(spark.createDataFrame([(None, 1.0, None)], df.schema))
    assert multivariate.double_centered_distances(lost, "id", ["a", "b"]).where("v IS NULL").count() == 41


def test_double_centring_is_written_in_little_room(spark, tmp_path):
    """Equal points stand together, whatever their keys: a row of 24 bytes takes less than one."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(100, 2))[rng.permutation(2000) % 100]
    spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "id long, a double, b double").write.parquet(str(tmp_path / "points"))
    multivariate.double_centered_distances(spark.read.parquet(str(tmp_path / "points")), "id", ["a", "b"]).write.parquet(str(tmp_path / "pairs"))
    pairs = spark.read.parquet(str(tmp_path / "pairs"))
    assert pairs.distinct().count() == pairs.count() == 2000**2
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 2000**2


def test_double_centring_of_points_that_share_a_key(spark):
    rows = [(1, 0.0, 1.0), (1, 2.0, 5.0), (2, 7.0, 1.0), (None, 3.0, 4.0), (None, 1.0, 1.0), (3, None, 2.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    q = {(s, t): (s[1] - t[1]) ** 2 + (s[2] - t[2]) ** 2 for s in rows[:5] for t in rows[:5]}
    mean = lambda key: np.mean([v for (s, _), v in q.items() if s[0] == key])
    wanted = sorted((str(s[0]), str(t[0]), round(float(-0.5 * (v - mean(s[0]) - mean(t[0]) + np.mean(list(q.values())))), 9)) for (s, t), v in q.items())
    found = multivariate.double_centered_distances(df, "id", ["a", "b"]).collect()
    assert sorted((str(r.i), str(r.j), round(r.v, 9)) for r in found if r.v is not None) == wanted and len(found) == 36
    assert multivariate.double_centered_distances(df.where("a IS NULL"), "id", ["a", "b"]).collect() == [(3, 3, None)]
    assert multivariate.double_centered_distances(df.limit(0), "id", ["a", "b"]).collect() == []


@pytest.mark.parametrize("dims", [3, 40])
def test_scaling_of_points_that_stay_with_the_tasks(spark, dims):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(150, dims)) * np.linspace(1, 3, dims)
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], ["id", *[f"x{k}" for k in range(dims)]]).repartition(5)
    near = multivariate.Proximities.of_points(df, "id", [f"x{k}" for k in range(dims)])
    dense = multivariate.classical_scaling(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), 2)
    found = multivariate.classical_scaling_of(near, 2)
    assert np.allclose(found.configuration, dense.configuration) and found.fit == pytest.approx(dense.fit)
    assert multivariate.classical_scaling_of(near).configuration.shape == (150, dims)
    with pytest.raises(ValueError):
        multivariate.classical_scaling_of(near, dims + 1)


def test_non_metric_scaling_of_points_that_stay_with_the_tasks(spark):
    x = np.random.default_rng(8).normal(size=(60, 3)) * [3, 2, 1]
    near = multivariate.Proximities.of_points(spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "id long, a double, b double, c double"), "id", ["a", "b", "c"])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert multivariate.non_metric_scaling_of(near, 3).fit < 1e-9
    for order in (2.0, 3.0):
        dense, found = (f(p, 2, order) for f, p in ((multivariate.non_metric_scaling, d), (multivariate.non_metric_scaling_of, near)))
        assert found.fit == pytest.approx(dense.fit, rel=1e-6) and found.fit > 0.01


def test_decompositions(points):
    x, _, df = points
    out, s, v = multivariate.tall_svd(df, ["a", "b", "c"])
    assert np.allclose(s, np.linalg.svd(x, compute_uv=False))
    u = np.array([r[-3:] for r in out.orderBy("id").collect()], float)
    assert np.allclose(u * s @ v.T, x)
    full, d, vh = multivariate.singular_value_decomposition(x)
    assert full.shape == (60, 60) and np.allclose(full @ d @ vh, x)
    assert np.allclose(multivariate.spectral_decomposition(x.T @ x)[0], np.sort(s**2))


def _values(spark, column, xs):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double").coalesce(1)
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


def test_distributions(spark):
    g = dist.Gaussian(-1.246312, 2.876598)
    assert _values(spark, g.pdf, [-0.1])[0] == pytest.approx(0.12809971437561)
    for d in (g, dist.Exponential(2.0), dist.Uniform(-1, 3), dist.GeneralizedPareto(1, 2, 0.3), dist.GeneralizedPareto(1, 2, -0.3), dist.GeneralizedPareto(0, 1, 0)):
        p = [0.05, 0.5, 0.95]
        assert _values(spark, lambda x, d=d: d.cdf(d.inverse_cdf(x)), p) == pytest.approx(p, abs=1e-9)
        assert all(math.isnan(v) for v in _values(spark, d.inverse_cdf, [-0.1, 1.1]))
    assert _values(spark, dist.Exponential(1.0).inverse_cdf, [1.0]) == [math.inf]
    assert math.isnan(_values(spark, dist.GeneralizedPareto(0, 1, 0.5).inverse_cdf, [1.0])[0])
    assert dist.GeneralizedPareto(0, 1, 1.0).mean == math.inf
    with pytest.raises(NotImplementedError):
        dist.Bernoulli(0.5).inverse_cdf(F.lit(0.5))
    with pytest.raises(ValueError):
        dist.FiniteDiscrete((1.0, 1.0), (0.5, 0.5))


@pytest.mark.parametrize("d", [dist.Bernoulli(0.3), dist.Uniform(2, 5), dist.Exponential(0.5), dist.Gaussian(1, 3), dist.GeneralizedPareto(0, 1, -0.2), dist.FiniteDiscrete((1.0, 4.0, 9.0), (0.2, 0.5, 0.3))])
def test_draws_have_the_mean(spark, d):
    n = 20_000
    found = d.sample(spark, n, seed=5).agg(F.avg("value")).first()[0]
    assert abs(found - d.mean) < 5 * d.standard_deviation / math.sqrt(n)


def test_conditional_bernoulli_sampling():
    golden = UnequalProbabilitySampling.from_bernoulli(np.arange(1, 10) / 10, 4)
    found = golden.inclusion_probabilities()
    assert found[0] == pytest.approx(0.060293314) and found[-1] == pytest.approx(0.895588146) and found.sum() == pytest.approx(4)
    pi = np.array([0.9, 0.2, 0.5, 0.4])
    assert np.allclose(UnequalProbabilitySampling.from_inclusion(pi).inclusion_probabilities(), pi, atol=1e-5)
    drawn = golden.draw(np.random.default_rng(0), 20_000)
    assert (drawn.sum(axis=1) == 4).all() and np.allclose(drawn.mean(axis=0), found, atol=0.02)
    with pytest.raises(ValueError):
        UnequalProbabilitySampling.from_bernoulli(np.array([0.0, 0.5]), 1)


def test_random_columns(spark):
    g = randoms.Generator(3)
    row = spark.range(5000).select(g.uniform("id", lower=2, upper=3).alias("u"), g.discrete_uniform("id", lower=0, upper=4).alias("d"), g.gaussian("id", mu=1, sigma=2).alias("g")).agg(F.avg("u"), F.max("d"), F.avg("g")).first()
    assert row[0] == pytest.approx(2.5, abs=0.05) and row[1] == 3 and row[2] == pytest.approx(1, abs=0.2)
    assert randoms.simple_sample(spark.range(500), "id", 20, seed=1).count() == 20
    twice = [sorted(tuple(r) for r in spark.range(0, 100, 1, parts).select("id", randoms.Generator(5).gaussian("id")).collect()) for parts in (1, 7)]
    assert twice[0] == twice[1]
    assert randoms.RandomDevice().seed != randoms.RandomDevice().seed
    streams = [randoms.next_stream(3, 4) for _ in range(5)]
    assert len({s.seed for s in streams}) == 4 and streams[0].seed == streams[4].seed
    positions = randoms.permutation(spark.range(50), "id", seed=1).select("position").collect()
    assert sorted(r[0] for r in positions) == list(range(50))


def test_special_functions(spark):
    row = spark.range(1).select(special.log_gamma(F.lit(5.0)), special.factorial(F.lit(25)), special.factorial(F.lit(4)), special.binomial(F.lit(6), F.lit(2)), special.normal_cdf(F.lit(0.0))).first()
    assert row[:] == pytest.approx((math.log(24), math.factorial(25), 24, 15, 0.5))
    assert special.factorial_of(171) == math.inf
    xs = [x / 7 for x in range(-60, 61)] + [26.0, 30.0]
    assert _values(spark, special.erfc, xs) == pytest.approx([math.erfc(x) for x in xs], rel=1e-13, abs=1e-300)
    assert _values(spark, special.normal_cdf, xs) == pytest.approx([0.5 * math.erfc(-x / math.sqrt(2)) for x in xs], rel=1e-12)
    p = [1e-300, 1e-20, 1e-5, 0.07, 0.3, 0.5, 0.6, 0.95, 1 - 1e-9]
    assert _values(spark, special.normal_quantile, p) == pytest.approx([NormalDist().inv_cdf(x) for x in p], rel=1e-11)
    assert _values(spark, special.normal_quantile, [0.0, 1.0]) == [-math.inf, math.inf] and math.isnan(_values(spark, special.normal_quantile, [1.5])[0])
    g = [1e-6, 0.5, 1.0, 1.5, 2.0, 9.999, 10.0, 171.5, 1e8]
    assert _values(spark, special.log_gamma, g) == pytest.approx([math.lgamma(x) for x in g], rel=1e-13, abs=1e-14)
    pairs = spark.range(400).select("id", F.explode(F.sequence(F.lit(0), F.col("id"), F.lit(17))).alias("k")).select("id", "k", special.binomial(F.col("id"), F.col("k")).alias("b")).collect()
    assert all(r.b == pytest.approx(float(math.comb(r.id, r.k)), rel=1e-11) for r in pairs) and all(r.b == math.comb(r.id, r.k) for r in pairs if r.id <= 50)
    for wrong in (special.log_gamma(F.lit(0.0)), special.factorial(F.lit(-1)), special.binomial(F.lit(3), F.lit(4))):
        with pytest.raises(Exception, match="needs"):
            spark.range(1).select(wrong).collect()
    plan = spark.range(3).select(special.normal_cdf(F.col("id")), special.binomial(F.col("id"), F.lit(0)))._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_derivatives():
    f = lambda x: math.sin(x[0]) * x[1] ** 2
    assert numeric.gradient(f, np.array([1.0, 2.0])) == pytest.approx([4 * math.cos(1), 4 * math.sin(1)], abs=1e-8)
    assert np.allclose(numeric.hessian(f, np.array([1.0, 2.0])), [[-4 * math.sin(1), 4 * math.cos(1)], [4 * math.cos(1), 2 * math.sin(1)]], atol=1e-4)


def test_cross_entropy(spark):
    assert crossentropy.minimize(lambda x: (x[0] - 3) ** 2, np.zeros(1))[0] == pytest.approx(3, abs=0.05)
    assert crossentropy.maximize(lambda x: -((x[0] + 1) ** 2), np.zeros(1))[0] == pytest.approx(-1, abs=0.05)
    values = np.array([5.0, 1, 9, 3, 8])
    context = crossentropy.Combination(lambda s: s @ values, 5, 2, maximize=True)
    for session in (None, spark):
        assert np.flatnonzero(crossentropy.optimize(context, 300, 0.05, spark=session).optimal_state).tolist() == [2, 4]
    level, elite = crossentropy.Continuous(None, np.zeros(1)).update_level(np.arange(100.0), 0.05)
    assert level == 5 and len(elite) == 6  # one more than the share


def test_clusters():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (8, 3)), rng.normal(4, 0.1, (8, 3))])
    x[:, 2] = rng.normal(size=16)
    parts = clusters.discover(x[:, :2], 2, seed=1)
    assert parts.tolist() == [0] * 8 + [1] * 8
    assert set(clusters.explain(x, parts, 2)) == {0, 1}


def test_explained_by_all_components(spark):
    from itertools import combinations

    from tessera.plans import models

    held = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    x, y = np.array([r.embedding for r in held], float), np.array([r.label for r in held])
    best = min(combinations(range(64), 2), key=lambda s: clusters.davies_bouldin(x[:, list(s)], y))
    assert tuple(r.component for r in models.clusters_explain(spark, "/root/testdata/sf0.01").collect()) == best


def test_rare_event():
    context = crossentropy.RareEvent(
        lambda s: s.sum(axis=1), lambda rng, p, n: rng.exponential(p, (n, len(p))), lambda s, u, v: np.exp((s * (1 / v - 1 / u)).sum(axis=1)) * np.prod(v / u), np.ones(2), 15.0
    )
    found = crossentropy.rare_event_probability(context, 2000, 0.1, 50_000).extra["probability"]
    assert found == pytest.approx(math.exp(-15) * 16, rel=0.1)


def test_small_singular_values_keep_their_digits(spark):
    rng = np.random.default_rng(6)
    q, _ = np.linalg.qr(rng.normal(size=(200, 3)))
    x = q * np.array([1.0, 1e-6, 1e-11]) @ np.linalg.qr(rng.normal(size=(3, 3)))[0]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").repartition(7)
    _, s, _ = multivariate.tall_svd(df, ["a", "b", "c"])
    assert s == pytest.approx([1.0, 1e-6, 1e-11], rel=1e-4)


def test_weights_are_checked(points):
    _, _, df = points
    assert multivariate.Cloud.checked(df, ["a", "b"], "w").variance() > 0
    with pytest.raises(ValueError):
        multivariate.Cloud.checked(df.withColumn("w", F.col("w") * 2), ["a"], "w")
    with pytest.raises(ValueError):
        multivariate.Cloud(df.withColumn("w", F.col("w") - 0.01), ("a",), "w").moments()
    moved = multivariate.Cloud(df, ("a", "b"), "w").rebase(multivariate.Basis(np.diag([2.0, 4.0])))
    assert moved.variance() == pytest.approx(multivariate.Cloud(df, ("a", "b"), "w").variance())
    assert np.allclose(multivariate.Basis.standard(2).matrix, np.eye(2))


def test_a_program_can_be_ended_early():
    class Early(crossentropy.Continuous):
        def stop_between(self, iteration, levels, parameters):
            return iteration == 2

    found = crossentropy.run(Early(lambda s: (s[:, 0] - 3) ** 2, np.zeros(1)), 100, 0.1)
    assert found.iterations == 2 and not found.converged
