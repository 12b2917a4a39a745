"""Categorical data, rules and partitions."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import categorical as cat
from tessera.operators import indexes
from tessera.operators import partition as part
from tessera.operators.classifier import EnsembleClassifier, Entailment, accuracy
from tessera.sources import matrix_files

ROWS = [("Red", "-2.2"), ("Green", "0"), ("Red", "-3.3"), ("White", "0"), ("Blue", "-1.1"), ("Blue", "0")]


@pytest.fixture(scope="module")
def colors(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "row long, COLOR string, NUMBER string")
    sign = lambda c: F.when(c.cast("double") < 0, "Negative").when(c.cast("double") == 0, "Zero").otherwise("Positive")
    return cat.encode(df, "row", ["COLOR", "NUMBER"], {"NUMBER": sign})


def test_codes_follow_first_appearance(colors):
    assert colors.categories("COLOR") == [(0, "Red"), (1, "Green"), (2, "White"), (3, "Blue")]
    assert [r.COLOR for r in colors.rows.orderBy("row_id").collect()] == [0, 1, 0, 2, 3, 3]


def test_decode_slice_and_disjoin(colors):
    assert [r.COLOR for r in colors.decode().orderBy("row_id").collect()] == [c for c, _ in ROWS]
    assert colors.slice([1, 3], ["NUMBER"]).rows.count() == 2
    one = colors.slice(variables=["COLOR"]).disjoin().orderBy("row_id").first()
    assert list(one)[1:] == [1, 0, 0, 0]


def test_contingency_holds_zero_cells(colors):
    found = {(r.row_label, r.column_label): r.n for r in colors.contingency("NUMBER", "COLOR").collect()}
    assert len(found) == 8 and found["Negative", "Red"] == 2 and found["Zero", "Red"] == 0


def test_unknown_codes_raise(colors):
    with pytest.raises(cat.UnknownCode):
        cat.from_encoded(colors.rows.withColumn("COLOR", F.lit(9.0)), colors.codebook, colors.variables)
    assert cat.from_encoded(colors.rows, colors.codebook, colors.variables).rows.count() == 6


def test_codebook_maintenance():
    book = cat.Codebook("x", [(0, "a")])
    book.add(2)
    assert book.get("2") == (2, "2") and book.get("z") is None
    with pytest.raises(ValueError):
        book.add(0, "b")
    assert book.remove(2) and not book.remove(2)
    book.set_read_only()
    with pytest.raises(ValueError):
        book.add(5)


def test_files(spark, colors, tmp_path):
    matrix_files.write_categorical(colors, str(tmp_path / "c"))
    assert sorted(map(tuple, matrix_files.read_categorical(spark, str(tmp_path / "c")).decode().collect())) == sorted(map(tuple, colors.decode().collect()))
    assert '"Code": 0.0, "Label": "Red"' in matrix_files.variable_json(colors, "COLOR")


def test_variables_rules_and_data_as_text(colors):
    book = cat.Codebook.from_matrix(colors.to_matrix("COLOR"))
    assert book.name == "COLOR" and book.items == colors.categories("COLOR")
    rule = Entailment((frozenset({0.0, 3.0}),), 1.0, 0.5)
    back, features, response = matrix_files.read_entailment_json(matrix_files.entailment_json(rule, colors, ["COLOR"], "NUMBER"))
    assert back == rule and features[0].items == colors.categories("COLOR") and response.name == "NUMBER"
    held = json.loads(matrix_files.categorical_json(colors, "set").first().json)
    assert held["Name"] == "set" and held["Data"]["Implementor"]["Storage"][:6] == [0, 1, 0, 2, 3, 3]


def test_delimited_text(spark, tmp_path):
    (tmp_path / "t.csv").write_text("A|B|C\n1|x|2\n3|y|4\n")
    found = matrix_files.read_delimited(spark, str(tmp_path / "t.csv"), [2, 0], "|").orderBy("row_id").collect()
    assert [tuple(r) for r in found] == [(0, "2", "1"), (1, "4", "3")]


def test_blocks(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, "a"), (4.0, "b"), (4.0, "a"), (5.0, "b")], "x double, y string")
    found = cat.blocks(df, "x", "y").orderBy("block").collect()
    assert [(r.low, r.high, r.n, r.target) for r in found] == [(1, 3, 2, "a"), (4, 4, 2, None), (5, 5, 1, "b")]


def test_entropy_cuts(spark):
    rows = [(float(x), "lo" if x < 50 else "hi") for x in range(100)]
    found = cat.entropy_categorizers(spark.createDataFrame(rows, "x double, y string"), ["x"], "y")["x"]
    df = spark.createDataFrame([(49.0,), (49.6,), (None,)], "x double").select(found(F.col("x")))
    assert [r[0] for r in df.collect()] == ["]-Inf, 49.5]", "]49.5, Inf[", None]
    assert cat.cut_points([(float(k), {"a": 1, "b": 1}) for k in range(20)]) == []


def test_rules_vote():
    rules = EnsembleClassifier(("f",), ((0.0, 1.0),), "y", (0.0, 1.0))
    with pytest.raises(ValueError):
        rules.add([{5.0}], 0.0)
    rules.add([{1.0}], 1.0, 0.8)
    assert "IF f IN {one} THEN y IS yes WITH TRUTH 0.8" == rules.rules[0].text(["f"], "y", {"f": {0.0: "zero", 1.0: "one"}, "y": {0.0: "no", 1.0: "yes"}})


def test_training_learns_a_rule(spark):
    rows = [(float(a), float(b), float(a == 2)) for a in range(4) for b in range(3) for _ in range(5)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    found = EnsembleClassifier(("a", "b"), ((0.0, 1.0, 2.0, 3.0), (0.0, 1.0, 2.0)), "y", (0.0, 1.0))
    found.train(df, 2, seed=1, draws=30)
    assert accuracy(found.classify(df), "predicted", "y").first()[0] == 1.0


def test_ties_are_repeatable(spark):
    rules = EnsembleClassifier(("f",), ((0.0, 1.0),), "y", (0.0, 1.0))
    df = spark.range(100).withColumn("f", F.lit(0.0))
    assert rules.classify(df).where("predicted <> 0").isEmpty()
    drawn = rules.classify(df, seed=3, key="id")
    assert 20 < drawn.where("predicted = 1").count() < 80
    assert drawn.collect() == rules.classify(df, seed=3, key="id").collect()


SETOSA = [(5.1, 3.5, 1.4, 0.2), (4.9, 3.0, 1.4, 0.2), (4.7, 3.2, 1.3, 0.2), (4.6, 3.1, 1.5, 0.2)]
VIRGINICA = [(6.3, 3.3, 6.0, 2.5), (5.8, 2.7, 5.1, 1.9), (7.1, 3.0, 5.9, 2.1), (6.3, 2.9, 5.6, 1.8)]


@pytest.fixture(scope="module")
def iris(spark):
    rows = [(k, "s", list(p)) for k, p in enumerate(SETOSA)] + [(k + 4, "v", list(p)) for k, p in enumerate(VIRGINICA)]
    return spark.createDataFrame(rows, "id long, part string, x array<double>")


def test_distances(iris):
    link = part.linkages(iris, "part", "x").first()
    assert (link.single, link.complete, link.average) == pytest.approx((4.17732, 5.529014, 4.932325), abs=1e-5)
    assert part.centroid_linkages(iris, "part", "x", 4).first().distance == pytest.approx(4.902168, abs=1e-5)
    assert {r.part: r.diameter for r in part.diameters(iris, "part", "x").collect()}["s"] == pytest.approx(0.6480741)
    assert part.distances(iris, "id", "x").count() == 28
    assert part.dunn_index(iris, "part", "x").first()[0] > 2
    assert part.davies_bouldin_index(iris, "part", "x", 4).first()[0] < 0.5


def test_a_single_point_has_no_diameter(iris):
    assert part.diameters(iris.where("id = 0"), "part", "x").first().diameter == -math.inf


def test_index_lists(spark):
    df = spark.range(1).select(
        indexes.sequence(0, 3, 9).alias("a"), indexes.index_range(2, 4).alias("b"), indexes.default(2).alias("c"), indexes.ordered(indexes.from_array([3, 1, 3])).alias("d")
    )
    row = df.first()
    assert (row.a, row.b, row.c, row.d) == ([0, 3, 6, 9], [2, 3, 4], [0, 1], [1, 3, 3])
    assert df.select(indexes.compare(F.col("a"), F.col("b")), indexes.compare(F.col("c"), F.col("b")), indexes.gather(F.col("a"), F.col("c")), indexes.largest(F.col("d"))).first()[:] == (1, -1, [0, 3], 3)
    with pytest.raises(ValueError):
        indexes.from_array([-1])


def test_cuts_of_a_table_equal_those_of_its_histogram(spark):
    """More distinct values than any histogram on the driver, mixed and pure, with several cuts."""
    import random

    rng = random.Random(4)
    small = [(rng.randrange(200) / 4, rng.choice("ab") if rng.random() < 0.2 else "abcb"[min(3, rng.randrange(4))]) for _ in range(800)]
    small += [(x / 4, "abca"[x // 60]) for x in range(240) for _ in range(5)]
    df = spark.createDataFrame([*small, (None, "a"), (1.0, None)], "x double, t string").repartition(4)
    histogram = {}
    for x, t in small:
        histogram.setdefault(x, {}).setdefault(t, 0)
        histogram[x][t] += 1
    expected = cat.cut_points(sorted(histogram.items()))
    assert len(expected) >= 3 and cat.table_cut_points(df, "x", "t") == expected
    large = spark.range(300_000).select((F.col("id") / 3.0).alias("x"), F.when(F.col("id") < 100_000, "a").when(F.col("id") % 2 == 0, "b").otherwise("c").alias("t"))
    assert cat.table_cut_points(large, "x", "t") == [(99_999 / 3.0 + 100_000 / 3.0) / 2]
    assert cat.table_cut_points(df.limit(0), "x", "t") == []


def test_supplementary_individuals_and_json(spark):
    from tessera.sources import matrix_files

    data = cat.encode(spark.createDataFrame([(k, "abca"[k], "xyyx"[k]) for k in range(4)], "id long, u string, v string"), "id", ["u", "v"])
    more = spark.createDataFrame([(9, 2.0, 1.0)], "row_id long, u double, v double")
    assert data.disjoin(supplementary=more).first()[:] == (9, 0.0, 0.0, 1.0, 0.0, 1.0)
    with pytest.raises(cat.UnknownCode):
        data.disjoin(supplementary=more.withColumn("u", F.lit(7.0)))
    back = matrix_files.read_categorical_json(matrix_files.categorical_json(data, "d"))
    assert sorted(map(tuple, back.decode().collect())) == sorted(map(tuple, data.decode().collect()))


def test_parts_in_long_and_packed_form(spark):
    df = spark.createDataFrame([(k, "ab"[k % 2], float(k)) for k in range(7)], "i long, v string, x double")
    packed = part.by_value(df, "i", "v")
    assert sorted(map(tuple, part.to_labels(packed).collect())) == sorted(map(tuple, part.labels_by_value(df, "i", "v").collect())) == [(k, "ab"[k % 2]) for k in range(7)]
    assert part.part_of(packed, "b").first().members == [1, 3, 5] and part.part_of(packed, "c").count() == 0


def test_pairs_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(part, "PAIRS", 20)
    df = spark.range(8).select("id", F.array(F.col("id").cast("double")).alias("x"))
    with pytest.raises(ValueError, match="28|all pairs"):
        part.distances(df, "id", "x")
    assert part.distances(df.limit(6), "id", "x").count() == 15
