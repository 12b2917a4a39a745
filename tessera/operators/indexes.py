"""Index lists as array columns: building, sorting, gathering, shortlex order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_array(indexes: Sequence[int]) -> Column:
    if not len(indexes):
        raise ValueError("an index list holds an index at least")
    if any(i < 0 for i in indexes):
        raise ValueError("indexes are not negative")
    return F.array(*[F.lit(int(i)) for i in indexes])


def default(size: int) -> Column:
    """0 to size - 1."""
    if size < 1:
        raise ValueError("a size is positive")
    return F.sequence(F.lit(0), F.lit(size - 1))


def index_range(first: int, last: int) -> Column:
    if not 0 <= first <= last:
        raise ValueError("a range runs upwards from an index")
    return F.sequence(F.lit(first), F.lit(last))


def sequence(first: int, increment: int, bound: int) -> Column:
    """first, first + increment, ... up to the bound, which may not be passed."""
    if first < 0 or bound < 0 or increment == 0 or (bound - first) * increment < 0:
        raise ValueError("the bound can't be reached")
    return F.sequence(F.lit(first), F.lit(bound), F.lit(increment))


def ordered(indexes: Column) -> Column:
    return F.array_sort(indexes)


def largest(indexes: Column) -> Column:
    return F.array_max(indexes)


def gather(indexes: Column, positions: Column) -> Column:
    """The indexes at some positions."""
    return F.transform(positions, lambda p: F.get(indexes, p))


def shortlex(indexes: Column) -> Column:
    """A sort key: shorter lists first, then by entries."""
    return F.struct(F.size(indexes).alias("size"), indexes.alias("entries"))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 in shortlex order."""
    return F.when(shortlex(a) < shortlex(b), -1).when(shortlex(a) > shortlex(b), 1).otherwise(0)
