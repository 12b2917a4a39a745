"""Golden values of the summary statistics."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import stats
from tessera.operators.frames import ieee_divide, with_row_id
from tessera.operators.matrix import Matrix

M40 = [(16, 5, 1, 4), (2, 11, 7, 14), (1, 10, 6, 15), (13, 8, 12, 1), (4, 3, 2, 1)]
COLUMNS = [f"c{k}" for k in range(5)]


@pytest.fixture(scope="module")
def m40(spark):
    rows = [(i, *(float(c[i]) for c in M40)) for i in range(4)]
    return spark.createDataFrame(rows, "row_id long, " + ", ".join(f"{c} double" for c in COLUMNS))


def test_covariance(m40):
    found = {(r.i, r.j): r.value for r in stats.covariance(m40, COLUMNS, adjust=True).collect()}
    assert [found[k, k] for k in range(5)] == pytest.approx([43, 27, 106 / 3, 89 / 3, 5 / 3])
    assert found[0, 1] == found[1, 0]


def test_correlation(m40):
    found = {(r.i, r.j): r.value for r in stats.correlation(m40, COLUMNS).collect()}
    assert found[0, 1] == pytest.approx(-0.69457793721244)
    assert found[1, 2] == pytest.approx(0.99286999263187)


def test_correlation_of_a_constant_is_nan(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert all(math.isnan(r.value) for r in stats.correlation(df, ["a", "b"]).where("i <> j or i = 0").collect())


def test_max_takes_the_lowest_index(m40):
    found = stats.on_columns(m40, COLUMNS, ["max"], index="row_id").collect()
    assert [(r["max"]["index"], r["max"]["value"]) for r in found] == [(0, 16), (3, 14), (3, 15), (0, 13), (0, 4)]


def test_kurtosis(m40):
    found = [r.kurtosis for r in stats.on_columns(m40, COLUMNS, ["kurtosis"], adjust=True).collect()]
    assert found == pytest.approx([2.912925906, -0.951989026, -0.593271627, 0.605226613, -1.2], abs=1e-8)


def test_kurtosis_of_entries(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 2, -3, 3, 4)], "x double")
    assert stats.on_all(df, ["x"], ["kurtosis"]).first()[0] == pytest.approx(0.1327204826)


def test_constant_shapes_are_nan_and_too_few_are_null(spark):
    df = spark.createDataFrame([(3.0,)] * 5, "x double")
    row = stats.on_columns(df, ["x"], ["skewness", "kurtosis"]).first()
    assert math.isnan(row.skewness) and math.isnan(row.kurtosis)
    with pytest.raises(stats.NotAdjustable):
        stats.check_adjustable(df.limit(1), "x", "variance")
    with pytest.raises(stats.NotAdjustable):
        stats.row_statistic("skewness", ["a", "b"], adjust=True)


def test_quantiles_of_a_hundred(spark):
    df = spark.range(1, 101).select(F.col("id").cast("double").alias("x"))
    found = {r.probability: r.quantile for r in stats.quantile(df, "x", [0.005, 0.5, 0.75, 0.999]).collect()}
    assert found == pytest.approx({0.005: 1, 0.5: 50.5, 0.75: 75.583333, 0.999: 100}, abs=1e-6)
    with pytest.raises(ValueError):
        stats.quantile(df, "x", [1.5])


def type8(xs, p):
    s = sorted(xs)
    h = max(1.0, min(float(len(s)), (len(s) + 1 / 3) * p + 1 / 3))
    k = int(h)
    return s[k - 1] + (h - k) * (s[min(k, len(s) - 1)] - s[k - 1])


def test_brackets_are_narrowed(spark, monkeypatch):
    """Brackets with too many values, and sketches that miss, give the same quantiles."""
    rng = random.Random(8)
    rows = [(rng.gauss(0, 1), float(rng.randrange(5)), None if k % 9 == 0 else rng.random(), "ab"[k % 3 == 0]) for k in range(2000)] + [(None, None, None, "c"), (1.0, 2.0, None, None)]
    df = spark.createDataFrame(rows, "x double, y double, z double, g string").repartition(3)
    probs = [0.0, 0.37, 0.99, 1.0]
    for inside, small, bracket, accuracy in ((30, 100, 0.2, 10_000), (40, 100, 0.01, 20)):
        for name, v in (("_INSIDE", inside), ("_SMALL", small), ("_BRACKET", bracket), ("_ACCURACY", accuracy)):
            monkeypatch.setattr(stats, name, v)
        for groups in (1,) if accuracy == 20 else (10_000,):
            monkeypatch.setattr(stats, "_GROUPS", groups)
            found = {(r.g, r.probability): r.quantile for r in stats.quantile(df, "x", probs, ["g"]).collect()}
            assert found == pytest.approx({(g, p): type8([r[0] for r in rows if r[3] == g and r[0] is not None], p) for g in ("a", "b", None) for p in probs})
        wide = {(r.variable, r.probability): r.quantile for r in stats.quantile_columns(df, ["x", "y", "z"], probs).collect()}
        assert wide == pytest.approx({(c, p): type8([r[i] for r in rows if r[i] is not None], p) for i, c in enumerate("xyz") for p in probs})


def test_row_quantiles_and_large_means(spark):
    rows = [(k, 1e9 + k % 7, 1e9 + (k * k) % 11, 1e9 - k % 5, float(1 + k % 3)) for k in range(50)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, w double")
    for p in (0.1, 0.5, 0.9):
        found = {r.id: r.q for r in df.select("id", stats.row_quantile(["a", "b", "c"], p).alias("q")).collect()}
        assert found == pytest.approx({r[0]: type8(r[1:4], p) for r in rows})
    x, w = np.array([r[1:4] for r in rows]), np.array([r[4] for r in rows])
    got = {r.variable: (r["mean"], r.variance) for r in stats.weighted_moments(df, ["a", "b"], "w").collect()}
    for i, c in enumerate("ab"):
        assert got[c][0] == pytest.approx(np.average(x[:, i], weights=w)) and got[c][1] == pytest.approx(np.average((x[:, i] - np.average(x[:, i], weights=w)) ** 2, weights=w), rel=1e-6)
    cells = [(k, j, float(v)) for k, r in enumerate(x[:6]) for j, v in enumerate(r) if (k + j) % 4]
    dense = np.zeros((6, 3))
    for k, j, v in cells:
        dense[k, j] = v
    got = {(r.i, r.k): r.value for r in stats.row_covariance(spark.createDataFrame(cells, "i long, j int, v double"), 3).collect()}
    assert got == pytest.approx({(i, k): np.cov(dense, bias=True)[i, k] for i in range(6) for k in range(6)}, rel=1e-6)


def test_quantiles_of_many_values_with_ties(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=20_000), 2)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    s = np.sort(x)
    found = stats.quantile(df, "x", [0.01, 0.37, 0.5, 0.99]).collect()
    for r in found:
        h = (len(s) + 1 / 3) * r.probability + 1 / 3
        k = int(h)
        assert r.quantile == pytest.approx(s[k - 1] + (h - k) * (s[k] - s[k - 1]))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=4, max_size=30))
def test_row_moments_agree_with_column_moments(spark, values):
    names = ["mean", "variance", "skewness", "kurtosis"]
    columns = [f"x{k}" for k in range(len(values))]
    wide = spark.createDataFrame([tuple(values)], ", ".join(f"{c} double" for c in columns))
    tall = spark.createDataFrame([(v,) for v in values], "x double")
    a, b = stats.on_rows(wide, columns, names).first(), stats.on_columns(tall, ["x"], names).first()
    assert a["mean"] == pytest.approx(b["mean"], rel=1e-6, abs=1e-6)
    assert a["variance"] == pytest.approx(b["variance"], rel=1e-6, abs=1e-3)


def test_sort_index(spark):
    # entries 1, 4, 2, 3 by linear index
    df = spark.createDataFrame([(0, 4.0), (1, 1.0), (2, 3.0), (3, 2.0)], "l long, v double")
    found = stats.sort_entries(df, "v", "l").orderBy("position").collect()
    assert [r["index"] for r in found] == [1, 3, 2, 0] and [r.value for r in found] == [1, 2, 3, 4]


def test_row_numbers_follow_the_order(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x"))
    assert with_row_id(df.repartition(7), ["x"]).where("row_id <> x").count() == 0


def test_division_like_ieee(spark):
    row = spark.range(1).select(*[ieee_divide(F.lit(a), F.lit(0.0)) for a in (1.0, -1.0, 0.0)]).first()
    assert row[0] == math.inf and row[1] == -math.inf and math.isnan(row[2])


def test_row_covariance(spark):
    m = np.array([[1.0, 2, 4], [3, 3, 0]])
    coord = Matrix.from_numpy(spark, m).entries
    found = {(r.i, r.k): r.value for r in stats.row_covariance(coord, 3).collect()}
    assert [found[0, 0], found[0, 1], found[1, 1]] == pytest.approx([np.cov(m, bias=True)[a] for a in ((0, 0), (0, 1), (1, 1))])
    r = {(x.i, x.k): x.value for x in stats.row_correlation(coord, 3).collect()}
    assert [r[0, 0], r[0, 1]] == pytest.approx([1, np.corrcoef(m)[0, 1]])
