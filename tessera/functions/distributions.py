"""Probability distributions: densities, distribution functions, inverses and draws as columns."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import special

NAN, INF = float("nan"), float("inf")


class Distribution:
    """pdf, cdf and inverse_cdf take a column; mean and variance are numbers; draw is a column."""

    can_invert = True
    mean: float
    variance: float

    @property
    def standard_deviation(self) -> float:
        return math.sqrt(self.variance)

    def pdf(self, x: Column) -> Column:
        raise NotImplementedError

    def cdf(self, x: Column) -> Column:
        raise NotImplementedError

    def inverse_cdf(self, p: Column) -> Column:
        raise NotImplementedError

    def draw(self, seed: int) -> Column:
        """A draw a row, by the inverse unless a distribution knows better."""
        return self.inverse_cdf(F.rand(seed))

    def sample(self, spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
        """n draws, a row each; the partitions draw on their own."""
        return spark.range(n).select("id", self.draw(seed).alias("value"))


def _probability(p: Column, inside: Column, open_ends: bool = False) -> Column:
    out = (p <= 0) | (p >= 1) if open_ends else (p < 0) | (p > 1)
    return F.when(out | F.isnan(p), F.lit(NAN)).otherwise(inside)


@dataclass(frozen=True)
class Bernoulli(Distribution):
    probability: float
    can_invert = False

    def __post_init__(self) -> None:
        if not 0 <= self.probability <= 1:
            raise ValueError("a probability lies in [0, 1]")

    @property
    def mean(self) -> float:
        return self.probability

    @property
    def variance(self) -> float:
        return self.probability * (1 - self.probability)

    @staticmethod
    def balanced() -> Bernoulli:
        return Bernoulli(0.5)

    def pdf(self, x: Column) -> Column:
        return F.when(x == 0, 1 - self.probability).when(x == 1, self.probability).otherwise(0.0)

    def cdf(self, x: Column) -> Column:
        return F.when(x < 0, 0.0).when(x < 1, 1 - self.probability).otherwise(1.0)

    def inverse_cdf(self, p: Column) -> Column:
        raise NotImplementedError("the distribution function has no inverse")

    def draw(self, seed: int) -> Column:
        return F.when(F.rand(seed) <= self.probability, 1.0).otherwise(0.0)


@dataclass(frozen=True)
class Uniform(Distribution):
    lower: float = 0.0
    upper: float = 1.0

    def __post_init__(self) -> None:
        if not self.lower < self.upper:
            raise ValueError("the lower bound lies below the upper one")

    @property
    def mean(self) -> float:
        return (self.lower + self.upper) / 2

    @property
    def variance(self) -> float:
        return (self.upper - self.lower) ** 2 / 12

    def pdf(self, x: Column) -> Column:
        return F.when((x >= self.lower) & (x <= self.upper), 1 / (self.upper - self.lower)).otherwise(0.0)

    def cdf(self, x: Column) -> Column:
        return F.when(x <= self.lower, 0.0).when(x >= self.upper, 1.0).otherwise((x - self.lower) / (self.upper - self.lower))

    def inverse_cdf(self, p: Column) -> Column:
        return _probability(p, self.lower + p * (self.upper - self.lower))


@dataclass(frozen=True)
class Exponential(Distribution):
    rate: float = 1.0

    def __post_init__(self) -> None:
        if not self.rate > 0:
            raise ValueError("a rate is positive")

    @property
    def mean(self) -> float:
        return 1 / self.rate

    @property
    def variance(self) -> float:
        return 1 / self.rate**2

    def pdf(self, x: Column) -> Column:
        return F.when(x < 0, 0.0).otherwise(self.rate * F.exp(-self.rate * x))

    def cdf(self, x: Column) -> Column:
        return F.when(x < 0, 0.0).otherwise(1 - F.exp(-self.rate * x))

    def inverse_cdf(self, p: Column) -> Column:
        # the logarithm of 0 is null in Spark
        return _probability(p, F.when(p == 1, F.lit(INF)).otherwise(-F.log(1 - p) / self.rate))


@dataclass(frozen=True)
class Gaussian(Distribution):
    mu: float = 0.0
    sigma: float = 1.0

    def __post_init__(self) -> None:
        if not self.sigma > 0:
            raise ValueError("a standard deviation is positive")

    @property
    def mean(self) -> float:
        return self.mu

    @property
    def variance(self) -> float:
        return self.sigma**2

    def pdf(self, x: Column) -> Column:
        z = (x - self.mu) / self.sigma
        return F.exp(-0.5 * z * z) / (self.sigma * math.sqrt(2 * math.pi))

    def cdf(self, x: Column) -> Column:
        return special.normal_cdf((x - self.mu) / self.sigma)

    def inverse_cdf(self, p: Column) -> Column:
        return self.mu + self.sigma * special.normal_quantile(p)

    def draw(self, seed: int) -> Column:
        return self.mu + self.sigma * F.randn(seed)


@dataclass(frozen=True)
class GeneralizedPareto(Distribution):
    mu: float = 0.0
    sigma: float = 1.0
    xi: float = 0.0

    def __post_init__(self) -> None:
        if not self.sigma > 0:
            raise ValueError("a scale is positive")

    @property
    def mean(self) -> float:
        return self.mu + self.sigma / (1 - self.xi) if self.xi < 1 else INF

    @property
    def variance(self) -> float:
        return self.sigma**2 / ((1 - self.xi) ** 2 * (1 - 2 * self.xi)) if self.xi < 0.5 else INF

    def _supported(self, x: Column) -> Column:
        inside = x >= self.mu
        return inside & (x <= self.mu - self.sigma / self.xi) if self.xi < 0 else inside

    def pdf(self, x: Column) -> Column:
        z = (x - self.mu) / self.sigma
        if self.xi == 0:
            value = F.exp(-z) / self.sigma
        else:
            base = 1 + self.xi * z
            value = F.when(base > 0, F.pow(F.greatest(base, F.lit(0.0)), F.lit(-1 / self.xi - 1)) / self.sigma).otherwise(F.lit(0.0 if self.xi > -1 else INF))
        return F.when(self._supported(x), value).otherwise(0.0)

    def cdf(self, x: Column) -> Column:
        z = (x - self.mu) / self.sigma
        value = 1 - F.exp(-z) if self.xi == 0 else 1 - F.pow(F.greatest(1 + self.xi * z, F.lit(0.0)), F.lit(-1 / self.xi))
        out = F.when(x < self.mu, 0.0)
        if self.xi < 0:
            out = out.when(x >= self.mu - self.sigma / self.xi, 1.0)
        return out.otherwise(value)

    def inverse_cdf(self, p: Column) -> Column:
        """Only inside the open unit interval."""
        q = 1 - p
        value = self.mu - self.sigma * F.log(q) if self.xi == 0 else self.mu + self.sigma * (F.pow(q, F.lit(-self.xi)) - 1) / self.xi
        return _probability(p, value, open_ends=True)


@dataclass(frozen=True)
class FiniteDiscrete(Distribution):
    values: tuple[float, ...]
    masses: tuple[float, ...]
    can_invert = False

    def __post_init__(self) -> None:
        if len(self.values) != len(self.masses) or len(set(self.values)) != len(self.values):
            raise ValueError("distinct values and as many masses are needed")
        if any(m < 0 for m in self.masses) or abs(sum(self.masses) - 1) > 1e-3:
            raise ValueError("masses aren't negative and sum to 1")

    @staticmethod
    def uniform(values: Sequence[float]) -> FiniteDiscrete:
        return FiniteDiscrete(tuple(values), (1 / len(values),) * len(values))

    @property
    def mean(self) -> float:
        return sum(v * m for v, m in zip(self.values, self.masses, strict=True))

    @property
    def variance(self) -> float:
        return sum((v - self.mean) ** 2 * m for v, m in zip(self.values, self.masses, strict=True))

    def pdf(self, x: Column) -> Column:
        out = F.lit(0.0)
        for v, m in zip(self.values, self.masses, strict=True):
            out = F.when(x == v, m).otherwise(out)
        return out

    def cdf(self, x: Column) -> Column:
        out = F.lit(0.0)
        for v, m in zip(self.values, self.masses, strict=True):
            out = out + F.when(x >= v, m).otherwise(0.0)
        return out

    def inverse_cdf(self, p: Column) -> Column:
        raise NotImplementedError("the distribution function has no inverse")

    def draw(self, seed: int) -> Column:
        """The value whose slice of [0, 1) holds a uniform draw: equal in law to an alias table."""
        slices, at = [], 0.0
        for v, m in zip(self.values, self.masses, strict=True):
            at += m
            slices.append((at, v))
        edges = F.array(*[F.struct(F.lit(a).alias("to"), F.lit(v).alias("v")) for a, v in slices])
        # one draw a row, looked up; the last slice takes what rounding leaves
        one = F.transform(F.array(F.rand(seed)), lambda u: F.coalesce(F.get(F.filter(edges, lambda e: u < e["to"]), F.lit(0))["v"], F.lit(slices[-1][1])))
        return F.get(one, F.lit(0))
