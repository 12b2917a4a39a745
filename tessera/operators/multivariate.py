"""Clouds of weighted points, principal projections, correspondence and scaling.

The data stay distributed: Spark aggregates the k x k matrix of second moments in one
pass, the driver decomposes it, and scores are column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .categorical import CategoricalFrame
from .frames import cut_lineage, fsum
from .partition import PAIRS, square_of_distances

#: Points of a scaling whose square of proximities is held on the driver.
SCALING_POINTS = 4000
#: Proximities that a task holds at a time (they fit into a cache), and that it works through in all.
CHUNK, TASK = 2**16, 2**25
#: A stress that is nothing but rounding.
NO_STRESS = 1e-9
#: Cells of a contingency table that is brought to the driver.
DRIVER_CELLS = 4_000_000


@dataclass(frozen=True)
class Basis:
    """The rows' coordinates refer to the columns of `matrix`."""

    matrix: np.ndarray

    def __post_init__(self) -> None:
        if self.matrix.ndim != 2 or self.matrix.shape[0] != self.matrix.shape[1] or np.linalg.matrix_rank(self.matrix) < len(self.matrix):
            raise ValueError("a basis matrix is square and regular")

    @staticmethod
    def standard(k: int) -> Basis:
        return Basis(np.eye(k))

    @property
    def products(self) -> np.ndarray:
        """Scalar products of the basis vectors."""
        return self.matrix.T @ self.matrix

    def scalar_product(self, left: Sequence[Column], right: Sequence[Column]) -> Column:
        q = self.products
        terms = [left[i] * right[j] * float(q[i, j]) for i in range(len(q)) for j in range(len(q)) if q[i, j] != 0]
        return fsum(terms)

    def squared_norm(self, x: Sequence[Column]) -> Column:
        """The scalar product of x with itself; no root is taken."""
        return self.scalar_product(x, x)

    def distance(self, left: Sequence[Column], right: Sequence[Column]) -> Column:
        gap = [a - b for a, b in zip(left, right, strict=True)]
        return F.sqrt(self.squared_norm(gap))

    def vectors(self, coordinates: Sequence[Column]) -> list[Column]:
        """Vectors in the standard basis."""
        return linear(coordinates, self.matrix.T)

    def coordinates(self, vectors: Sequence[Column]) -> list[Column]:
        return linear(vectors, np.linalg.inv(self.matrix.T))

    def change_coordinates(self, coordinates: Sequence[Column], new: Basis) -> list[Column]:
        """Coordinates of the same vectors in another basis."""
        return linear(coordinates, self.matrix.T @ np.linalg.inv(new.matrix.T))


def linear(columns: Sequence[Column], m: np.ndarray) -> list[Column]:
    """The row vector of columns times a small matrix."""
    return [fsum([columns[i] * float(m[i, j]) for i in range(m.shape[0]) if m[i, j] != 0] or [F.lit(0.0)]) for j in range(m.shape[1])]


@dataclass(frozen=True)
class Cloud:
    """Weighted points: a frame, coordinate columns, a weight column (None: all alike), a basis."""

    df: DataFrame
    columns: tuple[str, ...]
    weight: str | None = None
    basis: Basis | None = None

    @property
    def metric(self) -> Basis:
        return self.basis or Basis.standard(len(self.columns))

    def _w(self) -> Column:
        return F.lit(1.0) if self.weight is None else F.col(self.weight).cast("double")

    def validate(self) -> None:
        """Weights are not negative and sum to 1, within a thousandth."""
        if self.weight is None:
            return
        least, total = self.df.agg(F.min(self.weight), F.sum(self.weight)).first()
        if least is None or least < 0 or abs(total - 1) > 1e-3:
            raise ValueError("weights must not be negative and must sum to 1")

    @staticmethod
    def checked(df: DataFrame, columns: Sequence[str], weight: str | None = None, basis: Basis | None = None) -> Cloud:
        """A cloud whose weights are checked first: a pass over the weight column."""
        cloud = Cloud(df, tuple(columns), weight, basis)
        cloud.validate()
        return cloud

    def moments(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Mean, covariance (population) and total weight, from one pass; a negative weight raises."""
        k, w = len(self.columns), self._w()
        x = [F.col(c).cast("double") for c in self.columns]
        shift = self.df.select([F.first(a, True) for a in x]).first()  # sums about a point of the cloud keep digits
        at = [float(s or 0.0) for s in shift]
        cells = [F.sum(w).alias("w"), F.min(w).alias("least")] + [F.sum(w * (a - at[i])).alias(f"m{i}") for i, a in enumerate(x)]
        cells += [F.sum(w * (x[i] - at[i]) * (x[j] - at[j])).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]
        row = self.df.agg(*cells).first()
        total = row["w"]
        if row["least"] is None or row["least"] < 0 or not total > 0:
            raise ValueError("a cloud has points, and weights that aren't negative")
        mean = np.array([row[f"m{i}"] for i in range(k)]) / total
        cov = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / total - np.outer(mean, mean)
        return mean + np.array(at), cov, total

    def mean(self) -> np.ndarray:
        return self.moments()[0]

    def covariance(self) -> np.ndarray:
        return self.moments()[1]

    def variance(self) -> float:
        """Inertia: the weighted mean squared distance to the mean point."""
        return float(np.trace(self.covariance() @ self.metric.products))

    def variances(self, supplementary: Sequence[str]) -> dict[str, float]:
        """Weighted variances of other columns."""
        return dict(zip(supplementary, np.diag(Cloud(self.df, tuple(supplementary), self.weight).covariance()).tolist(), strict=True))

    def center(self) -> Cloud:
        mean = self.mean()
        out = self.df.withColumns({c: F.col(c) - float(m) for c, m in zip(self.columns, mean, strict=True)})
        return Cloud(out, self.columns, self.weight, self.basis)

    def standardize(self) -> Cloud:
        """Centred and divided by standard deviations, without a guard for constants (NaN there)."""
        from .frames import ieee_divide

        mean, cov, _ = self.moments()
        sd = np.sqrt(np.diag(cov))
        out = self.df.withColumns({c: ieee_divide(F.col(c) - float(m), F.lit(float(s))) for c, m, s in zip(self.columns, mean, sd, strict=True)})
        return Cloud(out, self.columns, self.weight, self.basis)

    def rebase(self, new: Basis) -> Cloud:
        moved = self.metric.change_coordinates([F.col(c) for c in self.columns], new)
        return Cloud(self.df.withColumns(dict(zip(self.columns, moved, strict=True))), self.columns, self.weight, new)

    def principal_projections(self) -> PrincipalProjections:
        return PrincipalProjections.of(self)


@dataclass(frozen=True)
class PrincipalProjections:
    """Directions of greatest variance of a cloud."""

    cloud: Cloud
    mean: np.ndarray
    covariance: np.ndarray
    total: float
    variances: np.ndarray
    axes: np.ndarray  # of vectors, orthonormal columns

    @staticmethod
    def of(cloud: Cloud) -> PrincipalProjections:
        mean, cov, total = cloud.moments()
        a = cloud.metric.matrix
        values, vectors = np.linalg.eigh(a @ cov @ a.T)
        order = np.argsort(values)[::-1]
        values, vectors = values[order], vectors[:, order]
        keep = values > max(values.max(initial=0), 0) * 1e-12
        values, vectors = values[keep], vectors[:, keep]
        # a direction's largest entry is positive
        inverse = np.linalg.inv(a) @ vectors
        lead = np.abs(np.round(inverse, 10)).argmax(axis=0) if inverse.size else np.zeros(0, int)
        signs = np.sign(inverse[lead, np.arange(inverse.shape[1])])
        return PrincipalProjections(cloud, mean, cov, total, values, vectors * np.where(signs == 0, 1, signs))

    @property
    def number_of_directions(self) -> int:
        return len(self.variances)

    @property
    def directions(self) -> np.ndarray:
        """Unit directions, in coordinates of the cloud's basis, one a column."""
        return np.linalg.inv(self.cloud.metric.matrix) @ self.axes

    def _scores(self, x: Sequence[Column]) -> list[Column]:
        centred = [c.cast("double") - float(m) for c, m in zip(x, self.mean, strict=True)]
        return linear(centred, self.cloud.metric.matrix.T @ self.axes)

    def coordinates(self, df: DataFrame | None = None, prefix: str = "pc") -> DataFrame:
        """The cloud's frame (or other points) with a column per direction."""
        df = self.cloud.df if df is None else df
        scores = self._scores([F.col(c) for c in self.cloud.columns])
        return df.withColumns({f"{prefix}{k + 1}": s for k, s in enumerate(scores)})

    def locate_supplementary_points(self, df: DataFrame) -> DataFrame:
        return self.coordinates(df)

    def contributions(self, prefix: str = "contribution") -> DataFrame:
        """Each point's share of each direction's variance."""
        w = self.cloud._w() / F.lit(float(self.total))
        scores = self._scores([F.col(c) for c in self.cloud.columns])
        return self.cloud.df.withColumns({f"{prefix}{k + 1}": w * s * s / float(v) for k, (s, v) in enumerate(zip(scores, self.variances, strict=True))})

    def representation_qualities(self, prefix: str = "quality") -> DataFrame:
        """Squared cosines of each point with each direction; NaN for a point at the mean."""
        from .frames import ieee_divide

        x = [F.col(c).cast("double") - float(m) for c, m in zip(self.cloud.columns, self.mean, strict=True)]
        norm = self.cloud.metric.squared_norm(x)
        scores = self._scores([F.col(c) for c in self.cloud.columns])
        return self.cloud.df.withColumns({f"{prefix}{k + 1}": ieee_divide(s * s, norm) for k, s in enumerate(scores)})

    @property
    def regression_coefficients(self) -> np.ndarray:
        """Of the cloud's variables on the standardised scores."""
        return self.covariance @ (self.cloud.metric.matrix.T @ self.axes) / np.sqrt(self.variances)

    @property
    def correlations(self) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.regression_coefficients / np.sqrt(np.diag(self.covariance))[:, None]

    def regress_supplementary_variables(self, columns: Sequence[str]) -> np.ndarray:
        """Coefficients of other variables of the same points; one pass."""
        scored = self.coordinates(prefix="_pc")
        w = self.cloud._w()
        k = range(self.number_of_directions)
        row = scored.agg(*[F.sum(w * F.col(c) * F.col(f"_pc{d + 1}")) for c in columns for d in k]).first()
        return np.array(row, float).reshape(len(columns), -1) / self.total / np.sqrt(self.variances)

    def correlate_supplementary_variables(self, columns: Sequence[str]) -> np.ndarray:
        variances = Cloud(self.cloud.df, tuple(columns), self.cloud.weight).covariance()
        return self.regress_supplementary_variables(columns) / np.sqrt(np.diag(variances))[:, None]


def principal_components(df: DataFrame, columns: Sequence[str], weight: str | None = None, coefficients: Sequence[float] | None = None) -> PrincipalProjections:
    """Principal components; coefficients weigh the variables (all 1: not standardised)."""
    basis = None
    if coefficients is not None:
        if any(c <= 0 for c in coefficients):
            raise ValueError("coefficients are positive")
        basis = Basis(np.diag(np.sqrt(np.asarray(coefficients, float))))
    return Cloud(df, tuple(columns), weight, basis).principal_projections()


@dataclass(frozen=True)
class Correspondence:
    """Row and column scores of a table of counts."""

    variances: np.ndarray
    row_weights: np.ndarray
    column_weights: np.ndarray
    row_coordinates: np.ndarray
    column_coordinates: np.ndarray


def correspondence_of(table: np.ndarray) -> Correspondence:
    """Reciprocal averaging of a small table: an SVD of its standardised residuals."""
    n = table.sum()
    r, c = table.sum(axis=1) / n, table.sum(axis=0) / n
    if not n > 0 or (r <= 0).any() or (c <= 0).any():
        raise ValueError("marginal sums must be positive")
    z = (table / n - np.outer(r, c)) / np.sqrt(np.outer(r, c))
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    keep = s > 1e-10
    u, s, v = u[:, keep], s[keep], vt[keep].T
    signs = np.sign(v[np.abs(np.round(v, 10)).argmax(axis=0), np.arange(v.shape[1])]) if v.size else np.ones(0)
    u, v = u * signs, v * signs
    return Correspondence(s**2, r, c, u / np.sqrt(r)[:, None] * s, v / np.sqrt(c)[:, None] * s)


def contingency_array(cells: DataFrame, row: str, column: str, count: str) -> tuple[np.ndarray, list, list]:
    """A small contingency table on the driver: its sides are numbers of categories."""
    held = cells.limit(DRIVER_CELLS + 1).collect()
    if len(held) > DRIVER_CELLS:
        raise ValueError(f"a table of more than {DRIVER_CELLS} cells isn't brought to the driver")
    rows, cols = sorted({r[row] for r in held}), sorted({r[column] for r in held})
    out, at, to = np.zeros((len(rows), len(cols))), {r: k for k, r in enumerate(rows)}, {c: k for k, c in enumerate(cols)}
    for r in held:
        out[at[r[row]], to[r[column]]] += r[count]
    return out, rows, cols


def correspondence(cells: DataFrame, row: str, column: str, count: str) -> Correspondence:
    return correspondence_of(contingency_array(cells, row, column, count)[0])


@dataclass(frozen=True)
class MultipleCorrespondence:
    """Categories' scores, and a projection of individuals."""

    variances: np.ndarray
    categories: list[tuple[str, float, str]]
    masses: np.ndarray
    category_coordinates: np.ndarray
    data: CategoricalFrame

    def individuals(self, prefix: str = "factor") -> DataFrame:
        """Each individual's scores: the scaled mean of its categories' scores, looked up and added."""
        m = self.category_coordinates / (len(self.data.variables) * np.sqrt(self.variances))
        rows, sums = self.data.rows, None
        for n, v in enumerate(self.data.variables):
            own = [(code, m[k].tolist()) for k, (name, code, _) in enumerate(self.categories) if name == v]
            table = rows.sparkSession.createDataFrame(own, f"_code{n} double, _s{n} array<double>")
            rows = rows.join(F.broadcast(table), F.col(v) == F.col(f"_code{n}"), "left").drop(f"_code{n}")
            sums = F.col(f"_s{n}") if sums is None else F.zip_with(sums, F.col(f"_s{n}"), lambda a, b: a + b)
        scores = rows.select(*self.data.rows.columns, sums.alias("_scores"))
        return scores.select(*self.data.rows.columns, *[F.get("_scores", F.lit(k)).alias(f"{prefix}{k + 1}") for k in range(m.shape[1])])


def multiple_correspondence(data: CategoricalFrame) -> MultipleCorrespondence:
    """Correspondence of the disjunctive table, from the joint counts of categories.

    One aggregation over distinct pairs of codes gives the Burt matrix; no row is a
    column of anything that reaches the driver.
    """
    cats = [(v, code, label) for v in data.variables for code, label in data.categories(v)]
    if len(cats) ** 2 > DRIVER_CELLS:
        raise ValueError(f"the joint counts of {len(cats)} categories are too many for the driver")
    place = {(v, c): k for k, (v, c, _) in enumerate(cats)}
    codes = F.array(*[F.struct(F.lit(v).alias("v"), F.col(v).alias("c")) for v in data.variables])
    grouped = data.rows.groupBy(*data.variables).agg(F.count(F.lit(1)).alias("n")).select("n", codes.alias("z"))
    pairs = grouped.select("n", "z", F.explode("z").alias("a")).select("n", "a", F.explode("z").alias("b")).groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    burt = np.zeros((len(cats), len(cats)))
    for r in pairs:
        burt[place[r.a.v, r.a.c], place[r.b.v, r.b.c]] = r.n
    q, n = len(data.variables), burt.diagonal().sum() / len(data.variables)
    masses = burt.diagonal() / (n * q)
    if (masses <= 0).any():
        raise ValueError("every category must occur")
    root = np.sqrt(masses)
    values, vectors = np.linalg.eigh(burt / (n * q * q) / np.outer(root, root) - np.outer(root, root))
    order = np.argsort(values)[::-1]
    keep = order[values[order] > 1e-10]
    values, vectors = values[keep], vectors[:, keep]
    signs = np.sign(vectors[np.abs(np.round(vectors, 10)).argmax(axis=0), np.arange(len(keep))]) if len(keep) else np.ones(0)
    return MultipleCorrespondence(values, cats, masses, vectors * signs / root[:, None] * np.sqrt(values), data)


def _means(sq: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Means of q by an index, a row a point (_key, _mean), and the mean of all (_total)."""
    sums = cut_lineage(sq.groupBy(F.col(by).alias("_key")).agg(F.sum("q").alias("_s"), F.count("q").alias("_n")))
    return sums.select("_key", F.try_divide("_s", "_n").alias("_mean")), sums.agg(F.try_divide(F.sum("_s"), F.sum("_n")).alias("_total"))


def double_centered(proximities: DataFrame) -> DataFrame:
    """-1/2 of the squared proximities (i, j, v), centred by rows and columns: i, j, v.

    Means are a row a point and are broadcast: no pair is shuffled.
    """
    sq = proximities.withColumn("q", F.col("v") * F.col("v"))
    (rows, total), (columns, _) = _means(sq, "i"), _means(sq, "j")
    out = sq.join(F.broadcast(rows.toDF("_i", "_r")), F.col("i").eqNullSafe(F.col("_i")), "left").join(F.broadcast(columns.toDF("_j", "_c")), F.col("j").eqNullSafe(F.col("_j")), "left")
    return out.crossJoin(F.broadcast(total)).select("i", "j", (-0.5 * (F.col("q") - F.col("_r") - F.col("_c") + F.col("_total"))).alias("v"))


def double_centered_distances(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """As double_centered, of the distances of points: i, j, v.

    The mean of a point's squared distances is its own from the mean point plus the mean of these,
    so means take passes over points; they are those of rows and of columns, a key's points
    together, and are joined to the points. Each pair is made once.
    """
    x = [F.col(c).cast("double") for c in columns]
    whole = df.where(fsum(x).isNotNull())
    middle = whole.agg(*[F.avg(c) for c in x]).first()
    gaps = [c - F.lit(m).cast("double") for c, m in zip(x, middle, strict=True)]
    own = fsum([g * g for g in gaps])
    spread = F.lit(whole.agg(F.avg(own)).first()[0]).cast("double")
    means = whole.groupBy(F.col(key).alias("_key")).agg((F.avg(own) + spread).alias("_mean"))
    points = df.select(key, *columns).join(F.broadcast(means), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    d = square_of_distances(points, key, columns, ["_mean"])
    return d.select(F.col("left").alias("i"), F.col("right").alias("j"), (-0.5 * (F.col("squared") - F.col("left__mean") - F.col("right__mean") + 2 * spread)).alias("v"))


@dataclass(frozen=True)
class Scaling:
    configuration: np.ndarray
    fit: float


def _square(proximities: np.ndarray) -> np.ndarray:
    p = np.asarray(proximities, float)
    if p.ndim != 2 or p.shape[0] != p.shape[1] or not np.array_equal(p, p.T):
        raise ValueError("proximities are a symmetric square")
    if len(p) > SCALING_POINTS:
        raise ValueError(f"at most {SCALING_POINTS} points can be scaled")
    return p


def classical_scaling(proximities: np.ndarray, dimension: int | None = None) -> Scaling:
    """Coordinates from the positive part of the spectrum; fit is the share of |eigenvalues| used."""
    p = _square(proximities)
    n = len(p)
    c = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-0.5 * c @ (p * p) @ c)
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    d = _dimension(values, dimension)
    return Scaling(_directed(vectors[:, :d] * np.sqrt(values[:d])), float(np.abs(values[:d]).sum() / np.abs(values).sum()))


def _dimension(values: np.ndarray, dimension: int | None) -> int:
    """The wanted number of positive eigenvalues; all by default."""
    positive = int((values > 1e-9 * max(1.0, np.abs(values).max(initial=0))).sum())
    d = positive if dimension is None else dimension
    if d < 1 or d > positive:
        raise ValueError("there aren't as many positive eigenvalues")
    return d


def _directed(x: np.ndarray) -> np.ndarray:
    """The columns' largest entries are positive."""
    return x * np.where(x[np.abs(x).argmax(axis=0), np.arange(x.shape[1])] < 0, -1, 1)


@dataclass(frozen=True)
class Proximities:
    """Euclidean distances of points on the driver, a square that no machine holds.

    Each pass computes it anew: tasks take its rows, a chunk at a time, and return a few numbers a row.
    """

    spark: SparkSession
    points: np.ndarray

    @staticmethod
    def of_points(df: DataFrame, key: str, columns: Sequence[str | Column]) -> Proximities:
        """Distances of a frame's rows, in the order of its key."""
        n = df.count()
        if n * (n - 1) // 2 > PAIRS or n * len(columns) > DRIVER_CELLS:
            raise ValueError(f"at most {PAIRS} pairs of points, of {DRIVER_CELLS} coordinates, are scaled")
        x = [(F.col(c) if isinstance(c, str) else c).cast("double").alias(f"x{k}") for k, c in enumerate(columns)]
        held = df.select(F.col(key).alias("_key"), *x).orderBy("_key").toArrow()
        points = np.column_stack([held.column(f"x{k}").to_numpy() for k in range(len(columns))])
        if not np.isfinite(points).all():
            raise ValueError("coordinates are finite numbers")
        return Proximities(df.sparkSession, points)

    def each_row(self, f: Callable[..., np.ndarray], width: int, *held: object) -> np.ndarray:
        """Of f(row numbers, their squared proximities, *held), `width` numbers a row: a pass over the square."""
        n = len(self.points)
        if not n:
            return np.zeros((0, width))
        sent, step = self.spark.sparkContext.broadcast((self.points, held)), max(1, CHUNK // n)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, own = sent.value
            for batch in batches:
                ids, y = batch.column(0).to_numpy(), []
                if not len(ids):
                    continue
                for rows in (ids[at : at + step] for at in range(0, len(ids), step)):
                    p = np.zeros((len(rows), n))
                    for c in x.T:
                        gap = np.subtract.outer(c[rows], c)
                        gap *= gap
                        p += gap
                    y.append(np.asarray(f(rows, p, *own), float).reshape(len(rows), width))
                ends = np.arange(len(ids) + 1, dtype=np.int32) * width
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(ends, np.concatenate(y).ravel())], ["row", "y"])

        tasks = min(n, max(self.spark.sparkContext.defaultParallelism, n * n // TASK))
        got = self.spark.range(0, n, 1, tasks).mapInArrow(run, "row long, y array<double>").toArrow()
        out = np.empty((n, width))
        out[got.column("row").to_numpy()] = got.column("y").combine_chunks().flatten().to_numpy().reshape(-1, width)
        sent.destroy()
        return out


def classical_scaling_of(proximities: Proximities, dimension: int | None = None) -> Scaling:
    """As classical_scaling, of a square that stays with the tasks.

    The range of the centred square is found from products with random columns, four times as many
    until what they leave of it (measured in a pass over all entries) is nothing to working
    precision; the spectrum is then whole, and so is the fit.
    """
    n = len(proximities.points)
    means = proximities.each_row(lambda rows, p: p.mean(axis=1), 1)[:, 0]
    centre = lambda a: a - a.mean(axis=0)
    width = min(n, (dimension or 0) + 8)

    def product(q: np.ndarray) -> np.ndarray:
        """The centred square times q."""
        return -0.5 * centre(proximities.each_row(lambda rows, p, q: p @ q, q.shape[1], centre(q)))

    def left(rows: np.ndarray, p: np.ndarray, means: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Squares of the entries less what the vectors u and values v give."""
        p -= means
        p -= (means[rows] - means.mean())[:, None]
        p *= 0.5
        p += (u[rows] * v) @ u.T
        return np.einsum("ij,ij->i", p, p)

    while True:
        q = np.linalg.qr(product(np.random.default_rng(0).normal(size=(n, width))))[0]
        bq = product(q)
        values, vectors = np.linalg.eigh(q.T @ bq)
        values, vectors = values[::-1], vectors[:, ::-1]
        rest = proximities.each_row(left, 1, means, q @ vectors, values).sum()
        if np.sqrt(n * rest) <= 1e-9 * np.abs(values).sum():  # bounds the sum of the other eigenvalues
            break
        width = min(n, 4 * width)
        if n <= SCALING_POINTS and 2 * width > n:
            return classical_scaling(np.sqrt(proximities.each_row(lambda rows, p: p, n)), dimension)
        if n * width > DRIVER_CELLS:
            raise ValueError(f"{n} points of more than {width // 4} dimensions are too many to scale")
    d = _dimension(values, dimension)
    return Scaling(_directed(bq @ vectors[:, :d] / np.sqrt(values[:d])), float(values[:d].sum() / np.abs(values).sum()))


def monotone_fit(order: np.ndarray, distances: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """The nearest numbers that don't fall along `order`; those of equal `ties` share one.

    Pools adjacent violators over blocks of ties.
    """
    out = np.empty_like(distances)
    level, weight, members = [], [], []
    at = 0
    while at < len(order):
        to = at
        while to < len(order) and ties[order[to]] == ties[order[at]]:
            to += 1
        own = order[at:to]
        level.append(distances[own].mean())
        weight.append(len(own))
        members.append([own])
        at = to
        while len(level) > 1 and level[-2] >= level[-1]:
            w = weight[-2] + weight[-1]
            level[-2] = (level[-2] * weight[-2] + level[-1] * weight[-1]) / w
            weight[-2] = w
            members[-2] += members[-1]
            level.pop(), weight.pop(), members.pop()
    for value, own in zip(level, members, strict=True):
        out[np.concatenate(own)] = value
    return out


def non_metric_scaling(dissimilarities: np.ndarray, dimension: int = 2, order: float = 2.0, iterations: int = 200, tolerance: float = 1e-4) -> Scaling:
    """Least stress (Kruskal's first) of a monotone regression, by descent from the classical solution.

    Distances are of Minkowski's `order`; the fit of the result is its stress.
    """
    p = _square(dissimilarities)
    n = len(p)
    i, j = np.triu_indices(n, 1)
    target = p[i, j]
    ranks = np.argsort(target, kind="stable")
    try:
        x = classical_scaling(p, dimension).configuration
    except ValueError:
        x = np.random.default_rng(0).normal(size=(n, dimension))

    def stress_of(x: np.ndarray) -> tuple[float, np.ndarray]:
        gap = x[i] - x[j]
        d = (np.abs(gap) ** order).sum(axis=1) ** (1 / order)
        fitted = monotone_fit(ranks, d, target)
        s, t = ((d - fitted) ** 2).sum(), (d**2).sum()
        stress = np.sqrt(s / t) if t else 0.0
        if not stress:
            return 0.0, np.zeros_like(x)
        pull = stress * ((d - fitted) / s - d / t)
        slope = np.sign(gap) * np.abs(gap) ** (order - 1) / np.maximum(d, 1e-300)[:, None] ** (order - 1)
        g = np.zeros_like(x)
        np.add.at(g, i, pull[:, None] * slope)
        np.add.at(g, j, -pull[:, None] * slope)
        return float(stress), g

    x = x - x.mean(axis=0)
    x = x / max(np.sqrt((x**2).sum() / n), 1e-300)
    stress, g = stress_of(x)
    step = 0.2
    for _ in range(iterations):
        size = np.sqrt((g**2).sum() / n)
        if stress < tolerance or size < tolerance:
            break
        for _ in range(30):  # the step shrinks until the stress falls
            y = x - step * g / size * np.sqrt((x**2).sum() / n)
            y = y - y.mean(axis=0)
            y = y / np.sqrt((y**2).sum() / n)
            new, h = stress_of(y)
            if new < stress:
                break
            step /= 2
        else:
            break
        done = stress - new < tolerance * stress * 1e-2
        x, stress, g, step = y, new, h, step * 1.5
        if done:
            break
    return Scaling(x, stress)


def _minkowski(x: np.ndarray, y: np.ndarray, order: float) -> np.ndarray:
    """Distances of rows of x and y."""
    out = np.zeros((len(x), len(y)))
    for a, b in zip(x.T, y.T, strict=True):
        gap = np.subtract.outer(a, b)
        out += gap * gap if order == 2 else np.abs(gap) ** order
    return np.sqrt(out) if order == 2 else out ** (1 / order)


def non_metric_scaling_of(proximities: Proximities, dimension: int = 2, order: float = 2.0, iterations: int = 200, tolerance: float = 1e-4) -> Scaling:
    """As non_metric_scaling, of a square that stays with the tasks.

    Multiples of the proximities are monotone, so the distance from the nearest multiple bounds the
    stress from above: where it is nothing to working precision, no order of pairs is needed.
    """
    n = len(proximities.points)
    try:
        x = classical_scaling_of(proximities, dimension).configuration
    except ValueError:
        x = np.random.default_rng(0).normal(size=(n, dimension))
    x = x - x.mean(axis=0)
    x = x / max(np.sqrt((x**2).sum() / max(n, 1)), 1e-300)

    def products(rows: np.ndarray, p: np.ndarray, x: np.ndarray) -> np.ndarray:
        d = _minkowski(x[rows], x, order)
        return np.column_stack([np.einsum("ij,ij->i", d, np.sqrt(p)), p.sum(axis=1), np.einsum("ij,ij->i", d, d)])

    def left(rows: np.ndarray, p: np.ndarray, x: np.ndarray, c: float) -> np.ndarray:
        gap = _minkowski(x[rows], x, order) - c * np.sqrt(p)
        return np.einsum("ij,ij->i", gap, gap)

    dv, vv, dd = proximities.each_row(products, 3, x).sum(axis=0)
    bound = np.sqrt(proximities.each_row(left, 1, x, dv / vv if vv else 0.0).sum() / dd) if dd else 0.0
    if bound <= NO_STRESS:
        return Scaling(x, float(bound))
    if n > SCALING_POINTS:
        raise ValueError(f"the pairs of at most {SCALING_POINTS} points are ordered")
    return non_metric_scaling(np.sqrt(proximities.each_row(lambda rows, p: p, n)), dimension, order, iterations, tolerance)


def spectral_decomposition(a: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and eigenvectors of a symmetric or Hermitian matrix; one triangle is read."""
    return np.linalg.eigh(a, UPLO="L" if lower else "U")


def singular_values(a: np.ndarray) -> np.ndarray:
    return np.linalg.svd(a, compute_uv=False)


def singular_value_decomposition(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Full U, rectangular diagonal, conjugate transpose of V, of a small matrix."""
    u, s, vh = np.linalg.svd(a, full_matrices=True)
    d = np.zeros(a.shape)
    np.fill_diagonal(d, s)
    return u, d, vh


def triangular_factor(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """R of the QR factorisation of a tall frame.

    Each task factors its rows batch by batch; the tasks' triangles are stacked and factored
    again in groups, so that the driver gets few of them.  No second moments are formed, so
    small singular values keep their digits.
    """
    k = len(columns)
    x = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, k))
        for batch in batches:
            own = np.column_stack([batch.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(k)])
            held = np.linalg.qr(np.concatenate([held, own]), mode="r") if len(own) else held
        yield pa.RecordBatch.from_arrays([pa.array(held[:, i]) for i in range(k)], [f"x{i}" for i in range(k)])

    shape = ", ".join(f"x{i} double" for i in range(k))
    parts = df.select(*x).dropna().mapInArrow(factor, shape)
    groups = max(1, int(df.sparkSession.sparkContext.defaultParallelism ** 0.5))
    few = parts.repartition(groups).mapInArrow(factor, shape).collect()
    r = np.array([tuple(row) for row in few], float).reshape(-1, k)
    return np.linalg.qr(r, mode="r") if len(r) else np.zeros((0, k))


def tall_svd(df: DataFrame, columns: Sequence[str], prefix: str = "u") -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Thin decomposition of a tall frame: the frame with U's columns, singular values, V.

    The values come from the triangular factor; U is an expression, never collected.
    Directions whose singular value is zero to working precision have no column.
    """
    x = [F.col(c).cast("double") for c in columns]
    _, s, vt = np.linalg.svd(triangular_factor(df, columns), full_matrices=False)
    keep = s > (s.max(initial=0) * len(columns) * np.finfo(float).eps)
    s, v = s[keep], vt[keep].T
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1, 1)
    return df.withColumns({f"{prefix}{d + 1}": e for d, e in enumerate(linear(x, v / s))}), s, v
