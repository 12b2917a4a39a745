"""Matrix operators against numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.matrix import Matrix, right_inverse
from tessera.sources import matrix_files

A = np.array([[1.0, 0, 2], [0, 3, -1]])
B = np.array([[0.5, 1, 0], [2, 0, 4]])


@pytest.fixture(scope="module")
def a(spark):
    return Matrix.from_numpy(spark, A)


@pytest.fixture(scope="module")
def b(spark):
    return Matrix.from_numpy(spark, B)


def test_entrywise(a, b):
    assert np.allclose((a + b).to_numpy(), A + B)
    assert np.allclose((a - b).to_numpy(), A - B)
    assert np.allclose((-a).to_numpy(), -A)
    assert np.allclose(a.hadamard(b).to_numpy(), A * B)
    assert np.allclose((a + 2.0).to_numpy(), A + 2)
    assert np.allclose((1.0 - a).to_numpy(), 1 - A)
    assert np.allclose((a * 3.0).to_numpy(), A * 3)


def test_products_and_transposes(a, b):
    assert np.allclose((a * b.transpose()).to_numpy(), A @ B.T)
    assert np.allclose(a.gram().to_numpy(), A.T @ A)
    with pytest.raises(ValueError):
        a * b
    with pytest.raises(ValueError):
        a + b.transpose()


def test_division(spark, a):
    with np.errstate(divide="ignore"):
        found = (1.0 / a).to_numpy()
        assert np.array_equal(found, 1 / A)
    square = np.array([[4.0, 1, 0], [1, 3, 1], [0, 1, 2]])
    x = (a / Matrix.from_numpy(spark, square)).to_numpy()
    assert np.allclose(x @ square, A)
    general = np.array([[0.0, 2, 1], [1, 0, 0], [3, 0, 1]])
    assert np.allclose((a / Matrix.from_numpy(spark, general)).to_numpy() @ general, A)
    oblong = np.array([[1.0, 2, 0]])
    assert np.allclose((a / Matrix.from_numpy(spark, oblong)).to_numpy(), A @ np.linalg.pinv(oblong))
    with pytest.raises(np.linalg.LinAlgError):
        right_inverse(np.ones((2, 2)))


def test_complex(spark, a, b):
    z, w = A + 1j * B, B - 2j * A
    m, n = a.as_complex() + b * 1j, b.as_complex() - a * 2j
    assert np.allclose(m.to_numpy(), z)
    assert np.allclose((m + a).to_numpy(), z + A)
    assert np.allclose((m * n.conjugate_transpose()).to_numpy(), z @ w.conj().T)
    assert np.allclose((m / (1 + 1j)).to_numpy(), z / (1 + 1j))
    h = Matrix.from_numpy(spark, np.array([[2, 1j], [-1j, 3]]))
    assert h.patterns()["hermitian"] and not h.patterns()["symmetric"]


def test_slices_and_searches(a):
    assert np.array_equal(a.slice([1, 0, 1], [2, 2]).to_numpy(), A[[1, 0, 1]][:, [2, 2]])
    assert np.array_equal(a.vec().to_numpy()[:, 0], A.ravel(order="F"))
    assert np.array_equal(a.vec([5, 0]).to_numpy()[:, 0], A.ravel(order="F")[[5, 0]])
    linear = lambda df: sorted(r.l for r in df.collect())
    assert linear(a.find(0.0)) == [1, 2]
    assert linear(a.find_nonzero()) == [0, 3, 4, 5]
    assert linear(a.find_while(lambda v: v < 1)) == [1, 2, 5]
    assert a.index_of(3.0) == 3 and a.index_of(9.0) == -1 and a.contains(-1.0)
    assert a.find(float("nan")).isEmpty()
    with pytest.raises(IndexError):
        a.slice([2], ":")


def test_building(spark, a):
    assert np.array_equal(Matrix.dense(spark, 2, 2, [1, 2, 3, 4]).to_numpy(), [[1, 3], [2, 4]])
    assert np.array_equal(Matrix.dense(spark, 2, 2, [1, 2, 3, 4], "row").to_numpy(), [[1, 2], [3, 4]])
    assert np.array_equal(Matrix.identity(spark, 3).to_numpy(), np.eye(3))
    assert np.array_equal(Matrix.diagonal(Matrix.dense(spark, 2, 1, [5, 6])).to_numpy(), np.diag([5, 6]))
    assert Matrix.dense(spark, 1, 1, [7]).scalar() == 7
    assert np.array_equal(Matrix.sparse(spark, 2, 3, [(1, 2, 4.0)]).to_numpy(), [[0, 0, 0], [0, 0, 4]])
    assert a.column_major() == A.ravel(order="F").tolist()
    labels = spark.createDataFrame([(0, 2.0), (1, 0.0), (2, 5.0)], "idx long, part double")
    assert Matrix.from_partition(labels, 3).column_major() == [2, 0, 5]
    with pytest.raises(ValueError):
        a.scalar()


@pytest.mark.parametrize(
    ("array", "holds", "fails"),
    [
        (np.diag([1.0, 2]), {"diagonal", "symmetric", "triangular", "bidiagonal"}, {"vector"}),
        (np.triu(np.ones((3, 3))), {"upper_triangular", "upper_hessenberg"}, {"lower_triangular", "tridiagonal"}),
        (np.array([[0.0, 2], [-2, 0]]), {"skew_symmetric", "tridiagonal"}, {"symmetric", "triangular"}),
        (np.ones((1, 3)), {"row_vector", "vector"}, {"square", "symmetric", "diagonal"}),
    ],
)
def test_patterns(spark, array, holds, fails):
    found = Matrix.from_numpy(spark, array).patterns()
    assert all(found[p] for p in holds) and not any(found[p] for p in fails)


def test_rows_in_shortlex_order(spark):
    m = Matrix.from_numpy(spark, np.array([[2.0, 1], [1, 5], [2, 1]]))
    assert [(r.row, r.members) for r in m.ordered_rows().collect()] == [([1, 5], [1]), ([2, 1], [0, 2])]


def test_apply(a):
    assert np.allclose(a.apply(lambda v: F.exp(v)).to_numpy(), np.exp(A))
    assert np.allclose(a.apply_python(lambda v: v + 1).to_numpy(), A + 1)


@pytest.mark.parametrize("sparse", [False, True])
@pytest.mark.parametrize("kind", [float, complex])
def test_files(spark, tmp_path, sparse, kind):
    array = A if kind is float else A + 1j * B
    m = Matrix.from_numpy(spark, array).set_names({0: "first"}, {1: "b", 2: "c"}, "held")
    matrix_files.write_csv(m, str(tmp_path / "m"), sparse)
    for back in (matrix_files.read_csv(spark, str(tmp_path / "m")), matrix_files.read_matrix_json(matrix_files.matrix_json(m, sparse))):
        assert np.allclose(back.to_numpy(), array)
        assert (back.name, back.row_names, back.col_names) == ("held", {0: "first"}, {1: "b", 2: "c"})


def test_first_line_of_a_file(spark, tmp_path):
    matrix_files.write_csv(Matrix.from_numpy(spark, A), str(tmp_path / "m"))
    assert [r.line for r in matrix_files.read_lines(spark, str(tmp_path / "m")).orderBy("n").collect()] == ["Dense|Double,2,3,,", ",,,", ",1.0,0.0,2.0,", ",0.0,3.0,-1.0,"]


def test_assignment(spark):
    a = np.arange(1.0, 21).reshape(4, 5)
    a[1, 2] = 0
    m = Matrix.from_numpy(spark, a)
    for rows, cols in ((1, 2), (0, ":"), (":", 3), (":", ":"), ([3, 1], [0, 4, 2]), (2, [1, 1]), ([0, 0, 2], ":"), (":", [4, 0]), ([1], 1)):
        r = range(4) if rows == ":" else [rows] if isinstance(rows, int) else rows
        c = range(5) if cols == ":" else [cols] if isinstance(cols, int) else cols
        for value in (7.5, 0.0, np.arange(float(len(r) * len(c))).reshape(len(r), len(c))):
            expected = a.copy()
            for p, i in enumerate(r):
                for q, j in enumerate(c):
                    expected[i, j] = value if isinstance(value, float) else value[p, q]
            given = value if isinstance(value, float) else Matrix.from_numpy(spark, value)
            if value is not None and not isinstance(value, float) and value.size == 1:
                continue
            assert (m.assign(rows, cols, given).to_numpy() == expected).all()
    assert (m.assign(0, 0, 2j).to_numpy()[0, 0]) == 2j
    with pytest.raises(IndexError):
        m.assign(4, 0, 1.0)
    with pytest.raises(ValueError):
        m.assign([0, 1], 0, Matrix.from_numpy(spark, np.ones((1, 2))))


def test_absent_zeros_meet_what_is_not_finite(spark):
    a = Matrix.sparse(spark, 2, 2, [(0, 0, 1.0), (0, 1, math.inf), (1, 0, 2.0)])
    b = Matrix.sparse(spark, 2, 2, [(0, 0, 3.0), (1, 1, math.nan)])
    with np.errstate(invalid="ignore"):
        assert np.array_equal(a.hadamard(b).to_numpy(), a.to_numpy() * b.to_numpy(), equal_nan=True)
        assert np.array_equal((a * math.inf).to_numpy(), a.to_numpy() * math.inf, equal_nan=True)
    assert (b.scalar_over(6.0).to_numpy()[0] == [2.0, math.inf]).all()


def test_products_with_either_side_small(spark, monkeypatch):
    from tessera.operators import matrix

    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(30, 4)), rng.normal(size=(4, 6))
    for cells in (0, 30, 10**6):
        monkeypatch.setattr(matrix, "BROADCAST_CELLS", cells)
        assert np.allclose((Matrix.from_numpy(spark, x) * Matrix.from_numpy(spark, y)).to_numpy(), x @ y)
        assert np.allclose((Matrix.from_numpy(spark, y.T) * Matrix.from_numpy(spark, x.T)).to_numpy(), y.T @ x.T)
