"""Matrices as coordinate frames (i, j, v), of doubles or of complex struct<re, im>.

A cell that has no row is zero, so the dense and the sparse form are one.  The shape,
names and the storage scheme are kept beside the frame.  Products join on the inner
index and combine before the shuffle, and a small side is broadcast; right-hand sides of a
division are small squares by nature and are factored on the driver, behind a check of
their size.

Entry-wise operations meet absent zeros with infinities and NaN as dense ones would (0
times infinity is NaN).  In matrix products an absent entry contributes nothing.
"""

from __future__ import annotations

import cmath
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import NAN, ieee_divide, with_row_id

#: Largest side of a matrix that is brought to the driver.
DRIVER_SIDE = 4096
#: Cells of a matrix that is broadcast in a product (some 24 bytes each).
BROADCAST_CELLS = 1_000_000
COMPLEX = "struct<re:double,im:double>"


def _pair(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


@dataclass(frozen=True)
class Field:
    """Arithmetic of a kind of entries, as column expressions."""

    complex: bool

    def zero(self) -> Column:
        return _pair(F.lit(0.0), F.lit(0.0)) if self.complex else F.lit(0.0)

    def literal(self, x: complex) -> Column:
        return _pair(F.lit(complex(x).real), F.lit(complex(x).imag)) if self.complex else F.lit(float(x))

    def add(self, a: Column, b: Column) -> Column:
        return _pair(a.re + b.re, a.im + b.im) if self.complex else a + b

    def subtract(self, a: Column, b: Column) -> Column:
        return _pair(a.re - b.re, a.im - b.im) if self.complex else a - b

    def negate(self, a: Column) -> Column:
        return _pair(0.0 - a.re, 0.0 - a.im) if self.complex else 0.0 - a

    def multiply(self, a: Column, b: Column) -> Column:
        return _pair(a.re * b.re - a.im * b.im, a.re * b.im + a.im * b.re) if self.complex else a * b

    def divide(self, a: Column, b: Column) -> Column:
        if not self.complex:
            return ieee_divide(a, b)
        size = b.re * b.re + b.im * b.im
        return _pair(ieee_divide(a.re * b.re + a.im * b.im, size), ieee_divide(a.im * b.re - a.re * b.im, size))

    def sum(self, a: Column) -> Column:
        return _pair(F.sum(a.re), F.sum(a.im)) if self.complex else F.sum(a)

    def nonzero(self, a: Column) -> Column:
        return (a.re != 0) | (a.im != 0) if self.complex else a != 0  # NaN isn't zero

    def equal(self, a: Column, x: complex) -> Column:
        if self.complex:
            return (a.re == complex(x).real) & (a.im == complex(x).imag)
        return F.lit(False) if x != x else (a == float(x)) & ~F.isnan(a)  # NaN equals nothing


@dataclass(frozen=True)
class Matrix:
    """An n_rows by n_cols matrix. entries: i long, j int, v; absent cells are zero."""

    entries: DataFrame
    n_rows: int
    n_cols: int
    name: str | None = None
    row_names: dict[int, str] = field(default_factory=dict)
    col_names: dict[int, str] = field(default_factory=dict)

    # -- building ------------------------------------------------------------------

    @staticmethod
    def _frame(spark: SparkSession, cells: Iterable[tuple[int, int, complex]], is_complex: bool) -> DataFrame:
        rows = [(int(i), int(j), (complex(v).real, complex(v).imag) if is_complex else float(v)) for i, j, v in cells]
        return spark.createDataFrame(rows, f"i long, j int, v {COMPLEX if is_complex else 'double'}")

    @staticmethod
    def dense(spark: SparkSession, n_rows: int, n_cols: int, values: complex | Sequence[complex] = 0.0, order: str = "column") -> Matrix:
        """From a constant, or from values in column or row order."""
        if n_rows < 1 or n_cols < 1:
            raise ValueError("a matrix has a row and a column at least")
        if isinstance(values, (int, float, complex)):
            f = Field(isinstance(values, complex))
            grid = spark.range(n_rows * n_cols).select((F.col("id") % n_rows).alias("i"), F.floor(F.col("id") / n_rows).cast("int").alias("j"))
            return Matrix(grid.withColumn("v", f.literal(values)), n_rows, n_cols)
        values = list(values)
        if len(values) != n_rows * n_cols:
            raise ValueError("the values don't fill the matrix")
        is_complex = any(isinstance(v, complex) for v in values)
        at = (lambda k: (k % n_rows, k // n_rows)) if order == "column" else (lambda k: (k // n_cols, k % n_cols))
        return Matrix(Matrix._frame(spark, ((*at(k), v) for k, v in enumerate(values)), is_complex), n_rows, n_cols)

    @staticmethod
    def sparse(spark: SparkSession, n_rows: int, n_cols: int, cells: Iterable[tuple[int, int, complex]] = ()) -> Matrix:
        cells = list(cells)
        return Matrix(Matrix._frame(spark, cells, any(isinstance(c[2], complex) for c in cells)), n_rows, n_cols)

    @staticmethod
    def identity(spark: SparkSession, n: int) -> Matrix:
        return Matrix(spark.range(n).select(F.col("id").alias("i"), F.col("id").cast("int").alias("j"), F.lit(1.0).alias("v")), n, n)

    @staticmethod
    def diagonal(values: Matrix) -> Matrix:
        """The linear entries of a matrix on a diagonal."""
        linear = (F.col("i") + F.col("j") * F.lit(values.n_rows)).cast("long")
        n = values.n_rows * values.n_cols
        return Matrix(values.entries.select(linear.alias("i"), linear.cast("int").alias("j"), "v"), n, n)

    @staticmethod
    def from_wide(df: DataFrame, row: str, columns: Sequence[str], n_rows: int | None = None) -> Matrix:
        """Columns of a frame that has row numbers; no shuffle."""
        cells = F.array(*[F.struct(F.lit(j).alias("j"), F.col(c).cast("double").alias("v")) for j, c in enumerate(columns)])
        flat = df.select(F.col(row).cast("long").alias("i"), F.explode(cells).alias("c")).select("i", "c.j", "c.v").where("v <> 0 or isnan(v)")
        n = n_rows if n_rows is not None else (df.agg(F.max(row)).first()[0] or 0) + 1
        return Matrix(flat, n, len(columns), col_names=dict(enumerate(columns)))

    @staticmethod
    def from_vectors(df: DataFrame, row: str, vector: str, n_rows: int, n_cols: int) -> Matrix:
        """An array column, one matrix row each."""
        flat = df.select(F.col(row).cast("long").alias("i"), F.posexplode(F.col(vector).cast("array<double>")).alias("j", "v"))
        return Matrix(flat.where("v <> 0 or isnan(v)"), n_rows, n_cols)

    @staticmethod
    def from_partition(labels: DataFrame, n_rows: int) -> Matrix:
        """The parts (idx, part; parts are numbers) of positions 0 on, as one column."""
        column = labels.select(F.col("idx").cast("long").alias("i"), F.lit(0).alias("j"), F.col("part").cast("double").alias("v"))
        return Matrix(column.where("v <> 0 or isnan(v)"), n_rows, 1)

    @property
    def spark(self) -> SparkSession:
        return self.entries.sparkSession

    @property
    def is_complex(self) -> bool:
        return dict(self.entries.dtypes)["v"].startswith("struct")

    @property
    def field(self) -> Field:
        return Field(self.is_complex)

    def as_complex(self) -> Matrix:
        return self if self.is_complex else self._with(self.entries.withColumn("v", _pair(F.col("v"), F.lit(0.0))))

    def _with(self, entries: DataFrame, n_rows: int | None = None, n_cols: int | None = None) -> Matrix:
        return replace(self, entries=entries, n_rows=self.n_rows if n_rows is None else n_rows, n_cols=self.n_cols if n_cols is None else n_cols)

    def filled(self) -> DataFrame:
        """All cells, zeros included: n_rows * n_cols rows."""
        grid = self.spark.range(self.n_rows * self.n_cols).select((F.col("id") % self.n_rows).alias("i"), F.floor(F.col("id") / self.n_rows).cast("int").alias("j"))
        return grid.join(self.entries, ["i", "j"], "left").select("i", "j", F.coalesce("v", self.field.zero()).alias("v"))

    def scalar(self) -> complex:
        """The entry of a 1 x 1 matrix."""
        if (self.n_rows, self.n_cols) != (1, 1):
            raise ValueError("only a 1 x 1 matrix is a scalar")
        row = self.entries.first()
        v = row.v if row else 0.0
        return complex(*v) if self.is_complex and row else v

    def to_numpy(self) -> np.ndarray:
        """The matrix on the driver, where its sides allow it."""
        if self.n_rows * self.n_cols > DRIVER_SIDE**2:
            raise ValueError("too large for the driver")
        out = np.zeros((self.n_rows, self.n_cols), complex if self.is_complex else float)
        for r in self.entries.collect():
            out[r.i, r.j] = complex(*r.v) if self.is_complex else r.v
        return out

    def column_major(self) -> list[complex]:
        """All entries, column by column, on the driver."""
        return self.to_numpy().ravel(order="F").tolist()

    @staticmethod
    def from_numpy(spark: SparkSession, a: np.ndarray) -> Matrix:
        at = np.argwhere(a != 0)
        cells = [(int(i), int(j), a[i, j].item()) for i, j in at]
        return Matrix(Matrix._frame(spark, cells, np.iscomplexobj(a)), *a.shape)

    # -- entry-wise ----------------------------------------------------------------

    def _same_kind(self, other: Matrix) -> tuple[Matrix, Matrix, Field]:
        if self.is_complex or other.is_complex:
            return self.as_complex(), other.as_complex(), Field(True)
        return self, other, Field(False)

    def _entrywise(self, other: Matrix | complex, f: Callable[[Field], Callable[[Column, Column], Column]]) -> Matrix:
        """Sum or difference; a 1 x 1 operand meets every cell, absent ones included."""
        other = self._lift(other)
        a, b, kind = self._same_kind(other)
        op = f(kind)
        if (b.n_rows, b.n_cols) == (1, 1):
            x = kind.literal(b.scalar())
            return a._with(a.filled().select("i", "j", op(F.col("v"), x).alias("v")))
        if (a.n_rows, a.n_cols) == (1, 1):
            x = kind.literal(a.scalar())
            return b._with(b.filled().select("i", "j", op(x, F.col("v")).alias("v")))
        if (a.n_rows, a.n_cols) != (b.n_rows, b.n_cols):
            raise ValueError("the shapes differ")
        joined = a.entries.join(b.entries.withColumnRenamed("v", "w"), ["i", "j"], "full_outer")
        return a._with(joined.select("i", "j", op(F.coalesce("v", kind.zero()), F.coalesce("w", kind.zero())).alias("v")))

    def _lift(self, other: Matrix | complex) -> Matrix:
        return other if isinstance(other, Matrix) else Matrix.dense(self.spark, 1, 1, [other])

    def __add__(self, other: Matrix | complex) -> Matrix:
        return self._entrywise(other, lambda k: k.add)

    def __radd__(self, other: complex) -> Matrix:
        return self._lift(other) + self

    def __sub__(self, other: Matrix | complex) -> Matrix:
        return self._entrywise(other, lambda k: k.subtract)

    def __rsub__(self, other: complex) -> Matrix:
        return self._lift(other) - self

    def __neg__(self) -> Matrix:
        return self._with(self.entries.select("i", "j", self.field.negate(F.col("v")).alias("v")))

    def scale(self, x: complex) -> Matrix:
        a = self.as_complex() if isinstance(x, complex) else self
        held = a.entries if cmath.isfinite(x) else a.filled()
        return a._with(held.select("i", "j", a.field.multiply(F.col("v"), a.field.literal(x)).alias("v")))

    def hadamard(self, other: Matrix) -> Matrix:
        """Entry-wise product."""
        a, b, kind = self._same_kind(other)
        if (a.n_rows, a.n_cols) != (b.n_rows, b.n_cols):
            raise ValueError("the shapes differ")
        joined = a.entries.join(b.entries.withColumnRenamed("v", "w"), ["i", "j"], "full_outer")
        out = joined.select("i", "j", kind.multiply(F.coalesce("v", kind.zero()), F.coalesce("w", kind.zero())).alias("v"))
        return a._with(out.where(kind.nonzero(F.col("v"))))

    def __mul__(self, other: Matrix | complex) -> Matrix:
        """Matrix product; a 1 x 1 operand scales."""
        other = self._lift(other)
        if (other.n_rows, other.n_cols) == (1, 1):
            return self.scale(other.scalar())
        if (self.n_rows, self.n_cols) == (1, 1):
            return other.scale(self.scalar())
        if self.n_cols != other.n_rows:
            raise ValueError("the inner sizes differ")
        a, b, kind = self._same_kind(other)
        right = b.entries.select(F.col("i").cast("int").alias("k"), F.col("j").alias("c"), F.col("v").alias("w"))
        if other.n_rows * other.n_cols <= BROADCAST_CELLS:
            right = F.broadcast(right)  # the left side's rows stay where they are
        left = a.entries.withColumnRenamed("j", "k")
        if self.n_rows * self.n_cols <= BROADCAST_CELLS < other.n_rows * other.n_cols:
            left = F.broadcast(left)
        joined = left.join(right, "k")
        out = joined.groupBy("i", F.col("c").alias("j")).agg(kind.sum(kind.multiply(F.col("v"), F.col("w"))).alias("v"))
        return Matrix(out, self.n_rows, other.n_cols, row_names=self.row_names, col_names=other.col_names)

    def __rmul__(self, other: complex) -> Matrix:
        return self.scale(other)

    def gram(self) -> Matrix:
        """Transpose times the matrix, by one pass over rows: each row's outer product, summed."""
        if self.n_cols > DRIVER_SIDE:
            return self.transpose() * self
        rows = self.entries.groupBy("i").agg(F.collect_list(F.struct("j", "v")).alias("r"))
        pairs = rows.select(F.explode("r").alias("a"), "r").select(F.col("a.j").cast("long").alias("i"), F.col("a.v").alias("v"), F.explode("r").alias("b"))
        kind = self.field
        return Matrix(pairs.groupBy("i", F.col("b.j").alias("j")).agg(kind.sum(kind.multiply(F.col("v"), F.col("b.v"))).alias("v")), self.n_cols, self.n_cols)

    def __truediv__(self, other: Matrix | complex) -> Matrix:
        """Division by a scalar, or the X with X * other = self."""
        other = self._lift(other)
        if (other.n_rows, other.n_cols) == (1, 1):
            a, b, kind = self._same_kind(other)
            return a._with(a.filled().select("i", "j", kind.divide(F.col("v"), kind.literal(b.scalar())).alias("v")))
        if (self.n_rows, self.n_cols) == (1, 1):
            return other.scalar_over(self.scalar())
        if self.n_cols != other.n_cols:
            raise ValueError("the numbers of columns differ")
        return self * Matrix.from_numpy(self.spark, right_inverse(other.to_numpy()))

    def scalar_over(self, x: complex) -> Matrix:
        """x divided by each entry."""
        a = self.as_complex() if isinstance(x, complex) else self
        return a._with(a.filled().select("i", "j", a.field.divide(a.field.literal(x), F.col("v")).alias("v")))

    def __rtruediv__(self, other: complex) -> Matrix:
        return self.scalar_over(other)

    def transpose(self) -> Matrix:
        swapped = self.entries.select(F.col("j").cast("long").alias("i"), F.col("i").cast("int").alias("j"), "v")
        return Matrix(swapped, self.n_cols, self.n_rows, self.name, self.col_names, self.row_names)

    def conjugate(self) -> Matrix:
        if not self.is_complex:
            return self
        return self._with(self.entries.select("i", "j", _pair(F.col("v").re, 0.0 - F.col("v").im).alias("v")))

    def conjugate_transpose(self) -> Matrix:
        return self.conjugate().transpose()

    def apply(self, f: Callable[[Column], Column]) -> Matrix:
        """A column expression of each entry, zeros included."""
        return self._with(self.filled().select("i", "j", f(F.col("v")).alias("v")))

    def apply_python(self, f: Callable[[float], float]) -> Matrix:
        """An arbitrary function of each entry, by Arrow batches."""

        @F.pandas_udf("double")
        def run(v):  # noqa: ANN001, ANN202
            return v.map(f).astype(float)

        return self.apply(run)

    # -- slices and searches -------------------------------------------------------

    def slice(self, rows: Sequence[int] | str = ":", cols: Sequence[int] | str = ":") -> Matrix:
        """Chosen rows and columns; repeats and any order are allowed, ":" is all."""
        out, shape, names = self.entries, [self.n_rows, self.n_cols], [self.row_names, self.col_names]
        for k, (axis, chosen) in enumerate((("i", rows), ("j", cols))):
            if isinstance(chosen, str):
                continue
            chosen = [chosen] if isinstance(chosen, int) else list(chosen)
            if any(not 0 <= x < shape[k] for x in chosen):
                raise IndexError("an index lies outside the matrix")
            kind = "long" if axis == "i" else "int"
            picked = self.spark.createDataFrame([(p, x) for p, x in enumerate(chosen)], f"_to {kind}, {axis} {kind}")
            out = out.join(F.broadcast(picked), axis).drop(axis).withColumnRenamed("_to", axis)
            shape[k], names[k] = len(chosen), {p: names[k][x] for p, x in enumerate(chosen) if x in names[k]}
        return Matrix(out.select("i", "j", "v"), *shape, self.name, *names)

    def assign(self, rows: Sequence[int] | int | str, cols: Sequence[int] | int | str, value: Matrix | complex) -> Matrix:
        """The matrix with other entries at chosen rows and columns, as m[rows, cols] = value.

        value is a number, or a matrix of the chosen shape; ":" is all, and of repeated
        indexes the last counts.
        """
        shape, lists = [self.n_rows, self.n_cols], []
        for k, chosen in enumerate((rows, cols)):
            if isinstance(chosen, str):
                lists.append(None)
                continue
            chosen = [chosen] if isinstance(chosen, int) else list(chosen)
            if not chosen or any(not 0 <= x < shape[k] for x in chosen):
                raise IndexError("an index lies outside the matrix")
            lists.append(chosen)
            shape[k] = len(chosen)
        value = self._lift(value)
        single = (value.n_rows, value.n_cols) == (1, 1)
        if not single and [value.n_rows, value.n_cols] != shape:
            raise ValueError("the value doesn't have the shape of the chosen entries")
        a, b, kind = self._same_kind(value)

        def places(chosen: list[int] | None, size: int, name: str, at: str) -> DataFrame:
            """(name: an index; at: the last place that it is chosen at)."""
            if chosen is None:
                return self.spark.range(size).select(F.col("id").alias(name), F.col("id").alias(at))
            return self.spark.createDataFrame(list({x: (x, p) for p, x in enumerate(chosen)}.values()), f"{name} long, {at} long")

        # what stays: all but entries whose row and column are both chosen
        inside = [places(c, n, x, "_p").select(F.col(x), F.lit(True).alias(f"_{x}")) for c, n, x in ((lists[0], self.n_rows, "i"), (lists[1], self.n_cols, "j"))]
        kept = a.entries
        for k, name in enumerate(("i", "j")):
            kept = kept.withColumn(f"_{name}", F.lit(True)) if lists[k] is None else kept.join(F.broadcast(inside[k]), name, "left")
        kept = kept.where(~(F.coalesce("_i", F.lit(False)) & F.coalesce("_j", F.lit(False)))).select("i", "j", "v")
        of_rows, of_cols = places(lists[0], self.n_rows, "i", "_r"), places(lists[1], self.n_cols, "j", "_c")
        if single:
            x = kind.literal(b.scalar())
            new = of_rows.crossJoin(F.broadcast(of_cols)) if lists[1] is not None or self.n_cols <= DRIVER_SIDE else of_cols.crossJoin(F.broadcast(of_rows))
            new = new.select("i", F.col("j").cast("int").alias("j"), x.alias("v"))  # as many cells as are assigned
        else:
            held = b.entries.select(F.col("i").alias("_r"), F.col("j").cast("long").alias("_c"), "v")
            new = held.join(of_rows, "_r").join(of_cols, "_c").select("i", F.col("j").cast("int").alias("j"), "v")
        return a._with(kept.unionByName(new.where(kind.nonzero(F.col("v")))))

    def linear(self) -> DataFrame:
        """The stored entries by linear index, column by column: l, v."""
        return self.entries.select((F.col("i") + F.col("j") * F.lit(self.n_rows)).cast("long").alias("l"), "v")

    def vec(self, indexes: Sequence[int] | None = None) -> Matrix:
        """The entries stacked by column, or those at some linear indexes, as one column."""
        stacked = self.linear().select(F.col("l").alias("i"), F.lit(0).alias("j"), "v")
        out = Matrix(stacked, self.n_rows * self.n_cols, 1)
        return out if indexes is None else out.slice(indexes)

    def find(self, value: complex) -> DataFrame:
        """Linear indexes of entries equal to value (column l); NaN equals nothing."""
        whole = self.filled() if value == 0 else self.entries
        return self._with(whole).linear().where(self.field.equal(F.col("v"), value)).select("l")

    def find_nonzero(self) -> DataFrame:
        return self.linear().where(self.field.nonzero(F.col("v"))).select("l")

    def find_while(self, predicate: Callable[[Column], Column]) -> DataFrame:
        """Linear indexes of entries, zeros included, that satisfy a predicate."""
        return self._with(self.filled()).linear().where(predicate(F.col("v"))).select("l")

    def index_of(self, value: complex) -> int:
        """The least linear index of a value, -1 if there is none."""
        found = self.find(value).agg(F.min("l")).first()[0]
        return -1 if found is None else found

    def contains(self, value: complex) -> bool:
        return not self.find(value).isEmpty()

    def set_names(self, rows: dict[int, str] | None = None, cols: dict[int, str] | None = None, name: str | None = None) -> Matrix:
        return replace(self, row_names=self.row_names | (rows or {}), col_names=self.col_names | (cols or {}), name=name or self.name)

    # -- patterns ------------------------------------------------------------------

    def bandwidths(self) -> tuple[int, int]:
        """Lower and upper bandwidth: how far non-zero entries lie from the diagonal."""
        held = self.entries.where(self.field.nonzero(F.col("v")))
        low, up = held.agg(F.max(F.col("i") - F.col("j")), F.max(F.col("j") - F.col("i"))).first()
        return max(0, low or 0), max(0, up or 0)

    def _mirrored(self, sign: int, conjugate: bool) -> bool:
        """Whether each entry is (minus) the (conjugate) entry across the diagonal."""
        if self.n_rows != self.n_cols:
            return False
        flip = self.conjugate_transpose() if conjugate else self.transpose()
        other = flip.scale(-1.0) if sign < 0 else flip
        kind = self.field
        joined = self.entries.join(other.entries.withColumnRenamed("v", "w"), ["i", "j"], "full_outer")
        gap = kind.subtract(F.coalesce("v", kind.zero()), F.coalesce("w", kind.zero()))
        return joined.where(kind.nonzero(gap)).isEmpty()

    def patterns(self) -> dict[str, bool]:
        """All pattern flags. Bandwidth patterns need a square matrix."""
        square = self.n_rows == self.n_cols
        low, up = self.bandwidths()
        out = {
            "vector": 1 in (self.n_rows, self.n_cols),
            "row_vector": self.n_rows == 1,
            "column_vector": self.n_cols == 1,
            "scalar": self.n_rows == self.n_cols == 1,
            "square": square,
            "symmetric": self._mirrored(1, False),
            "skew_symmetric": self._mirrored(-1, False),
            "diagonal": square and low == up == 0,
            "lower_triangular": square and up == 0,
            "upper_triangular": square and low == 0,
            "triangular": square and 0 in (low, up),
            "lower_hessenberg": square and up <= 1,
            "upper_hessenberg": square and low <= 1,
            "hessenberg": square and min(low, up) <= 1,
            "tridiagonal": square and max(low, up) <= 1,
            "lower_bidiagonal": square and up == 0 and low <= 1,
            "upper_bidiagonal": square and low == 0 and up <= 1,
            "bidiagonal": square and (min(low, up) == 0 and max(low, up) <= 1),
        }
        if self.is_complex:
            out |= {"hermitian": self._mirrored(1, True), "skew_hermitian": self._mirrored(-1, True)}
        return out

    # -- rows ----------------------------------------------------------------------

    def rows(self) -> DataFrame:
        """Each row as an array: i, row. Rows without entries are rows of zeros."""
        held = self.filled().groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("r"))
        return held.select("i", F.col("r.v").alias("row"))

    def ordered_rows(self) -> DataFrame:
        """Distinct rows in order with the rows that hold them: position, row, members.

        Rows of a matrix are of one length, for which shortlex is the order of arrays.
        """
        grouped = self.rows().groupBy("row").agg(F.array_sort(F.collect_list("i")).alias("members"))
        return with_row_id(grouped, ["row"], "position").select("position", "row", "members")


def right_inverse(right: np.ndarray) -> np.ndarray:
    """The R with left * R the solution X of X * right = left.

    Triangular matrices are substituted, symmetric ones tried by Cholesky, other squares
    factored with pivots; oblong ones are solved by least squares and need full rank.
    """
    n, k = right.shape
    if n == k:
        eye = np.eye(n, dtype=right.dtype)
        if np.linalg.matrix_rank(right) < n:
            raise np.linalg.LinAlgError("the matrix is singular")
        if np.allclose(right, right.conj().T, rtol=0, atol=0):
            try:
                c = np.linalg.cholesky(right)
                half = np.linalg.solve(c, eye)
                return half.conj().T @ half
            except np.linalg.LinAlgError:
                pass
        return np.linalg.solve(right, eye)
    if np.linalg.matrix_rank(right) < min(n, k):
        raise np.linalg.LinAlgError("the matrix has no full rank")
    return np.linalg.pinv(right)


__all__ = ["COMPLEX", "NAN", "Field", "Matrix", "right_inverse"]
