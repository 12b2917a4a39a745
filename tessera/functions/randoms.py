"""Random columns and streams with explicit seeds; equal in law, not bit for bit, to other libraries.

Columns are hashes of a row's key under a seed: a row that is computed again, on whatever
task, draws the same number again.
"""

from __future__ import annotations

import math
import os
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.frames import with_row_id


@dataclass
class Generator:
    """Draws on the driver (numpy) or as columns; each column call takes the next seed."""

    seed: int = 0

    def __post_init__(self) -> None:
        self.local = np.random.Generator(np.random.MT19937(self.seed))
        self._next = self.seed

    def next_seed(self) -> int:
        self._next += 1
        return self._next

    def default_uniform(self, *key: Column | str) -> Column:
        """Uniform in [0, 1), of 53 bits of a hash of the key columns."""
        if not key:
            raise ValueError("random columns need a key that tells rows apart")
        return F.shiftrightunsigned(F.xxhash64(F.lit(self.next_seed()), *key), 11).cast("double") * 2.0**-53

    def uniform(self, *key: Column | str, lower: float = 0.0, upper: float = 1.0) -> Column:
        return lower + (upper - lower) * self.default_uniform(*key)

    def discrete_uniform(self, *key: Column | str, lower: int, upper: int) -> Column:
        """Integers from lower to below upper."""
        if not lower < upper:
            raise ValueError("the lower bound lies below the upper one")
        return (lower + F.floor(self.default_uniform(*key) * (upper - lower))).cast("int")

    def gaussian(self, *key: Column | str, mu: float = 0.0, sigma: float = 1.0) -> Column:
        """Box and Muller's transformation of two uniform columns."""
        radius = F.sqrt(-2.0 * F.log(1.0 - self.default_uniform(*key)))
        return mu + sigma * radius * F.cos(2.0 * math.pi * self.default_uniform(*key))


class RandomDevice(Generator):
    """A generator whose seed comes from the machine's entropy: no two are alike."""

    def __init__(self) -> None:
        super().__init__(int.from_bytes(os.urandom(6)))


_STREAMS = {"next": 0}


def next_stream(seed: int = 0, streams: int = 6024) -> Generator:
    """One of a family of generators, in turn."""
    k = _STREAMS["next"] % streams
    _STREAMS["next"] += 1
    return Generator(seed * streams + k)


def permutation(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """The frame with `position`, a random permutation. Ordered by a seeded hash of the key,
    so that a lost task gives the same rows again."""
    return with_row_id(df.withColumn("_u", F.xxhash64(F.lit(seed), F.col(key))), ["_u", key], "position").drop("_u")


def simple_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows, each with the probability n / N."""
    total = df.count()
    if not 0 < n <= total:
        raise ValueError("a sample holds some of the population's units")
    keyed = df.withColumn("_u", F.xxhash64(F.lit(seed), F.col(key)))
    # a threshold keeps little more than n rows, of which the first n are taken
    limit = -(2.0**63) + 2.0**64 * min(1.0, (n + 6 * n**0.5 + 20) / total)
    near = keyed.where(F.col("_u").cast("double") <= limit)
    if near.limit(n).count() < n:  # not for any practical seed
        near = keyed
    return with_row_id(near, ["_u", key], "_k").where(F.col("_k") < n).drop("_u", "_k")
