"""Categorical data: encoding, codebooks, contingency, discretisation by entropy.

A data set is a wide frame of codes and a codebook (variable, code, label); codes are
0, 1, 2, ... per variable in the order of first appearance.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import INF, cut_lineage, with_row_id, with_running
from .matrix import Matrix


#: Categories of a variable that are listed on the driver.
CATEGORIES = 100_000


@dataclass(frozen=True)
class CategoricalFrame:
    """rows: row_id and a code column per variable; codebook: variable, code, label."""

    rows: DataFrame
    codebook: DataFrame
    variables: tuple[str, ...]

    def decode(self) -> DataFrame:
        """Codes back to labels."""
        out = self.rows
        for v in self.variables:
            book = self.codebook.where(F.col("variable") == v).select(F.col("code").alias(v), F.col("label").alias("_label"))
            out = out.join(book, v, "left").drop(v).withColumnRenamed("_label", v)
        return out.select("row_id", *self.variables)

    def slice(self, individuals: Sequence[int] | None = None, variables: Sequence[str] | None = None) -> CategoricalFrame:
        chosen = tuple(variables or self.variables)
        rows = self.rows if individuals is None else self.rows.where(F.col("row_id").isin(list(individuals)))
        return CategoricalFrame(rows.select("row_id", *chosen), self.codebook.where(F.col("variable").isin(*chosen)), chosen)

    def categories(self, variable: str) -> list[tuple[float, str]]:
        """(code, label) of a variable, in order, as a list on the driver, of CATEGORIES at most."""
        held = self.codebook.where(F.col("variable") == variable).orderBy("code").limit(CATEGORIES + 1).collect()
        if len(held) > CATEGORIES:
            raise ValueError(f"{variable} has more than {CATEGORIES} categories")
        return [(r.code, r.label) for r in held]

    def to_matrix(self, variable: str) -> Matrix:
        """A variable's codes as a column whose rows are named by the labels."""
        cats = self.categories(variable)
        cells = Matrix.dense(self.rows.sparkSession, len(cats), 1, [c for c, _ in cats])
        return cells.set_names({k: label for k, (_, label) in enumerate(cats)}, name=variable)

    def disjoin(self, checked: bool = True, supplementary: DataFrame | None = None) -> DataFrame:
        """One 0/1 column `variable=label` per category; an unknown code raises.

        supplementary: other individuals (row_id and codes), by the categories of this data set.
        """
        rows = self.rows if supplementary is None else supplementary
        if checked:
            validate(rows, self.codebook, self.variables)
        cells = [(F.col(v) == code).cast("double").alias(f"{v}={label}") for v in self.variables for code, label in self.categories(v)]
        return rows.select("row_id", *cells)

    def contingency(self, row: str, column: str) -> DataFrame:
        """Joint counts with all zero cells: row_code, row_label, column_code, column_label, n."""
        counts = self.rows.groupBy(F.col(row).alias("row_code"), F.col(column).alias("column_code")).agg(F.count(F.lit(1)).alias("n"))
        book = lambda v, p: self.codebook.where(F.col("variable") == v).select(F.col("code").alias(f"{p}_code"), F.col("label").alias(f"{p}_label"))
        cells = book(row, "row").crossJoin(book(column, "column"))  # two codebooks
        return cells.join(counts, ["row_code", "column_code"], "left").select("row_code", "row_label", "column_code", "column_label", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def codebook_of(df: DataFrame, row: str, variables: Sequence[str]) -> DataFrame:
    """variable, code, label: the distinct tokens of each variable by first appearance.

    Tokens are grouped before anything is ordered, so a window sees one row per category.
    """
    pairs = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("label")) for v in variables])
    flat = df.select(F.col(row).alias("_row"), F.explode(pairs).alias("_p")).select("_row", "_p.variable", "_p.label").where("label is not null")
    first = flat.groupBy("variable", "label").agg(F.min("_row").alias("_first"))
    w = Window.partitionBy("variable").orderBy("_first", "label")
    return first.select("variable", (F.row_number().over(w) - 1).cast("double").alias("code"), "label")


def encode(df: DataFrame, row: str, variables: Sequence[str], categorizers: dict[str, Callable[[Column], Column]] | None = None) -> CategoricalFrame:
    """Tokens to codes; a categorizer turns a column's tokens into labels first."""
    variables = tuple(variables)
    special = categorizers or {}
    labelled = df.select(F.col(row).alias("row_id"), *[(special[v](F.col(v)) if v in special else F.col(v)).cast("string").alias(v) for v in variables])
    book = cut_lineage(codebook_of(labelled, "row_id", variables))  # one scan for all variables
    out = labelled
    for v in variables:
        own = book.where(F.col("variable") == v).select(F.col("label").alias(v), F.col("code").alias("_code"))
        out = out.join(own, v, "left").drop(v).withColumnRenamed("_code", v)
    return CategoricalFrame(out.select("row_id", *variables), book, variables)


def encode_numbers(df: DataFrame, columns: Sequence[str], codifiers: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Text columns to doubles; a codifier may be any expression (or a pandas UDF)."""
    special = codifiers or {}
    return df.select(*[c for c in df.columns if c not in columns], *[(special[c](F.col(c)) if c in special else F.col(c)).cast("double").alias(c) for c in columns])


def date_codifier(column: Column) -> Column:
    """Milliseconds since the epoch."""
    return F.unix_millis(column.cast("timestamp")).cast("double")


class UnknownCode(ValueError):
    """An entry that the codebook doesn't hold."""


def validate(rows: DataFrame, codebook: DataFrame, variables: Sequence[str]) -> None:
    """Raise unless each entry is a code of its variable."""
    pairs = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("code")) for v in variables])
    flat = rows.select(F.explode(pairs).alias("p")).select("p.*").distinct()
    bad = flat.join(codebook, ["variable", "code"], "left_anti").first()
    if bad is not None:
        raise UnknownCode(f"{bad.variable} has no category with code {bad.code}")


def from_encoded(rows: DataFrame, codebook: DataFrame, variables: Sequence[str], row: str = "row_id") -> CategoricalFrame:
    """Existing codes and a codebook as a data set, after a check of every entry."""
    rows = rows.select(F.col(row).alias("row_id"), *[F.col(v).cast("double").alias(v) for v in variables])
    validate(rows, codebook, variables)
    return CategoricalFrame(rows, codebook, tuple(variables))


class Codebook:
    """Maintenance of one variable's categories: codes and labels are unique."""

    def __init__(self, name: str, categories: Sequence[tuple[float, str]] = ()):
        self.name, self.items, self.locked = name, [], False
        for code, label in categories:
            self.add(code, label)

    def add(self, code: float, label: str | None = None) -> None:
        label = label if label is not None else f"{code:g}"
        if self.locked:
            raise ValueError("the variable is read-only")
        if not label.strip() or any(code == c or label == lab for c, lab in self.items):
            raise ValueError("codes and labels are unique and labels not blank")
        self.items.append((float(code), label))

    def remove(self, code: float) -> bool:
        if self.locked:
            raise ValueError("the variable is read-only")
        before = len(self.items)
        self.items = [x for x in self.items if x[0] != code]
        return len(self.items) < before

    def get(self, key: float | str) -> tuple[float, str] | None:
        return next((x for x in self.items if key in x), None)

    def set_read_only(self) -> None:
        self.locked = True

    @staticmethod
    def from_matrix(column: Matrix) -> Codebook:
        """The variable whose codes are a column's entries; unnamed rows are labelled by their codes."""
        codes = column.column_major()
        return Codebook(column.name or "", [(c, column.row_names.get(k, f"{c:g}")) for k, c in enumerate(codes)])

    def rows(self) -> list[tuple[str, float, str]]:
        return [(self.name, c, lab) for c, lab in sorted(self.items)]


def bins(df: DataFrame, numeric: str, target: str) -> DataFrame:
    """Per distinct value its target counts: value, counts map<target, n>, n, pure (the only target, or null)."""
    counted = df.select(F.col(numeric).cast("double").alias("value"), F.col(target).cast("string").alias("target")).groupBy("value", "target").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("value").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("target", "n")))).alias("counts"),
        F.sum("n").alias("n"),
        F.when(F.count(F.lit(1)) == 1, F.first("target")).alias("pure"),
    )


def blocks(df: DataFrame, numeric: str, target: str) -> DataFrame:
    """Runs of neighbouring pure values of one target merge: block, low, high, n, target (null: mixed).

    Distinct values are numbered range by range and meet their neighbour by number, so a
    column of as many values as rows needs no task for all of them.
    """
    b = with_row_id(bins(df, numeric, target).select("value", "n", "pure"), ["value"], "_k")
    before = b.select((F.col("_k") + 1).alias("_k"), F.col("pure").alias("_before"))
    same = F.coalesce(F.col("pure") == F.col("_before"), F.lit(False))
    flagged = b.join(before, "_k", "left").select("value", "n", "pure", F.when(same, 0).otherwise(1).cast("long").alias("_new"))
    numbered = with_running(flagged, ["value"], {"block": F.col("_new")}).withColumn("block", F.col("block") - 1)
    return numbered.groupBy("block").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("n").alias("n"), F.first("pure").alias("target"))


def _entropy(counts: dict[str, int]) -> float:
    n = sum(counts.values())
    return math.log2(n) - sum(c * math.log2(c) for c in counts.values() if c) / n if n else 0.0


def _merged(parts: Sequence[dict[str, int]]) -> dict[str, int]:
    out: dict[str, int] = {}
    for p in parts:
        for k, v in p.items():
            out[k] = out.get(k, 0) + v
    return out


def _accepted(parts: Sequence[dict]) -> bool:
    """Whether a cut into two parts (target counts) shortens the description."""
    parts = [{t: m for t, m in p.items() if m} for p in parts]
    whole = _merged(parts)
    n, k, h = sum(whole.values()), len(whole), _entropy(whole)
    gain = h - sum(sum(p.values()) * _entropy(p) for p in parts) / n
    return gain > (math.log2(n - 1) + math.log2(3**k - 2) - (k * h - sum(len(p) * _entropy(p) for p in parts))) / n


def cut_points(histogram: Sequence[tuple[float, dict[str, int]]]) -> list[float]:
    """Cuts by least weighted entropy, accepted while the description length falls.

    histogram: value and target counts, by value.  Only borders between blocks are tried.
    """
    values, counts = [h[0] for h in histogram], [dict(h[1]) for h in histogram]
    pure = [next(iter(c)) if len(c) == 1 else None for c in counts]
    borders = [k for k in range(1, len(values)) if pure[k] is None or pure[k] != pure[k - 1]]
    found: list[float] = []
    stack = [(0, len(values))]
    while stack:
        lo, hi = stack.pop()
        whole = _merged(counts[lo:hi])
        n = sum(whole.values())
        left: dict[str, int] = {}
        best, at, right = None, lo, dict(whole)
        for cut in (b for b in borders if lo < b < hi):
            for c in counts[at:cut]:
                for t, m in c.items():
                    left[t] = left.get(t, 0) + m
                    right[t] -= m
            at = cut
            r = {t: m for t, m in right.items() if m}
            a, z = sum(left.values()), sum(r.values())
            e = (a * _entropy(left) + z * _entropy(r)) / n
            if best is None or e < best[0] - 1e-12:
                best = (e, cut)
        if best is None:
            continue
        cut = best[1]
        if _accepted([_merged(counts[lo:cut]), _merged(counts[cut:hi])]):
            found.append((values[cut - 1] + values[cut]) / 2)
            stack += [(lo, cut), (cut, hi)]
    return sorted(found)


def interval_label(cuts: Sequence[float]) -> Callable[[Column], Column]:
    """A categorizer: the interval, open to the left and closed to the right, that holds a number."""
    edges = [-INF, *cuts, INF]
    text = lambda x: "-Inf" if x == -INF else "Inf" if x == INF else f"{x:g}"

    def categorize(column: Column) -> Column:
        x, out = column.cast("double"), F.lit(None).cast("string")
        for a, z in reversed(list(zip(edges[:-1], edges[1:], strict=True))):
            label = f"]{text(a)}, {text(z)}" + ("[" if z == INF else "]")
            out = F.when(x <= z if z < INF else x.isNotNull(), F.lit(label)).otherwise(out)
        return out

    return categorize


#: Classes of a target, at most: a count of each is held for every border.
TARGETS = 10_000


def _entropy_of(counts: Column, n: Column) -> Column:
    """Entropy in bits of an array of counts with the sum n."""
    parts = F.aggregate(counts, F.lit(0.0), lambda a, c: a + F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(0.0))
    return F.when(n > 0, F.log2(n.cast("double")) - parts / n).otherwise(0.0)


def table_cut_points(df: DataFrame, numeric: str, target: str) -> list[float]:
    """cut_points of a column's histogram against a target, which stays where it is.

    Running counts of the targets are kept at each border between blocks; a pass over the
    borders finds the best cut of every open segment, and the driver decides from its counts
    whether to accept it.  One pass for each level of cuts.
    """
    held = df.select(F.col(numeric).cast("double").alias("value"), F.col(target).cast("string").alias("target")).where("value is not null and target is not null and not isnan(value)")
    names = sorted(r.target for r in held.select("target").distinct().limit(TARGETS + 1).collect())
    if len(names) > TARGETS:
        raise ValueError(f"more than {TARGETS} classes")
    if not names:
        return []
    one = lambda k, name: F.sum((F.col("target") == name).cast("long")).alias(f"n{k}")
    by_value = held.groupBy("value").agg(*[one(k, name) for k, name in enumerate(names)])
    sums = {f"c{k}": F.col(f"n{k}") for k in range(len(names))} | {"place": F.lit(1).cast("long")}
    running = with_running(by_value, ["value"], sums)
    pure = F.when(F.size(F.filter(F.array(*[F.col(f"n{k}") for k in range(len(names))]), lambda c: c > 0)) == 1, F.array_position(F.array(*[(F.col(f"n{k}") > 0) for k in range(len(names))]), True))
    counts = F.array(*[F.col(f"c{k}") for k in range(len(names))])
    listed = cut_lineage(running.select("place", "value", pure.alias("pure"), counts.alias("to")))
    after = listed.select((F.col("place") - 1).alias("place"), F.col("value").alias("next"), F.col("pure").alias("next_pure"))
    same = F.coalesce(F.col("pure") == F.col("next_pure"), F.lit(False))
    borders = cut_lineage(listed.join(after, "place").where(~same).select("value", "next", "to"))
    total = held.agg(*[one(k, name) for k, name in enumerate(names)]).first()
    shape = "id int, low double, high double, before array<long>, whole array<long>"
    found: list[float] = []
    open_ = [(-INF, INF, [0] * len(names), list(total))]
    while open_:
        segments = [(i, low, high, before, [b - a for a, b in zip(before, to, strict=True)]) for i, (low, high, before, to) in enumerate(open_)]
        met = borders.join(F.broadcast(df.sparkSession.createDataFrame(segments, shape)), (F.col("value") >= F.col("low")) & (F.col("next") <= F.col("high")))
        left = F.zip_with("to", "before", lambda t, b: t - b)
        met = met.withColumn("left", left).withColumn("right", F.zip_with("whole", "left", lambda w, x: w - x))
        size = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
        met = met.withColumns({"a": size("left"), "z": size("right")}).where("a > 0 and z > 0")
        price = (F.col("a") * _entropy_of(F.col("left"), F.col("a")) + F.col("z") * _entropy_of(F.col("right"), F.col("z"))) / (F.col("a") + F.col("z"))
        best = met.groupBy("id").agg(F.min(F.struct(F.round(price, 12).alias("e"), "value", "next", "to")).alias("b")).collect()
        again = []
        for r in best:
            low, high, before, to = open_[r.id]
            parts = [[y - x for x, y in zip(before, r.b.to, strict=True)], [y - x for x, y in zip(r.b.to, to, strict=True)]]
            if _accepted([dict(enumerate(p)) for p in parts]):
                found.append((r.b.value + r.b.next) / 2)
                again += [(low, r.b.value, before, r.b.to), (r.b.next, high, r.b.to, to)]
        open_ = again
    return sorted(found)


def entropy_categorizers(df: DataFrame, numeric: Sequence[str], target: str) -> dict[str, Callable[[Column], Column]]:
    """A categorizer per numeric column, from the column's histogram against the target."""
    return {c: interval_label(table_cut_points(df, c, target)) for c in numeric}
