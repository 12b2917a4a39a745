"""Summary statistics over all entries, by column or by row of a wide frame.

By column everything of one call is a single aggregation with map-side combining; by
row it is an array expression without any shuffle.  Moments are population moments
unless `adjust`ed for bias; as in the classical definitions, skewness and kurtosis of
a constant are NaN, kurtosis is in excess of 3, and quantiles are of type 8.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import INF, NAN, cut_lineage, fsum, ieee_divide, long, unpivot_row, with_row_id

#: Least number of values for the adjusted statistics.
LEAST = {"variance": 2, "standard_deviation": 2, "skewness": 3, "kurtosis": 4}
STATISTICS = ("sum", "mean", "sum_of_squared_deviations", "variance", "standard_deviation", "skewness", "kurtosis", "min", "max")


class NotAdjustable(ValueError):
    """Too few values for a bias-adjusted statistic."""


def _finish(name: str, adjust: bool, n: Column, m2: Column, g1: Column, g2: Column) -> Column:
    """A statistic from count, population variance, g1 and excess g2 (null for a constant)."""
    if name == "sum_of_squared_deviations":
        return m2 * n
    if name in ("variance", "standard_deviation"):
        v = F.when(n > 1, F.try_divide(m2 * n, n - 1)) if adjust else m2
        return F.sqrt(v) if name == "standard_deviation" else v
    if name == "skewness":
        out = F.when(n > 2, F.try_divide(g1 * F.sqrt(n * (n - 1.0)), n - 2)) if adjust else g1
    else:
        out = F.when(n > 3, F.try_divide((n - 1.0) * ((n + 1.0) * g2 + 6), (n - 2.0) * (n - 3.0))) if adjust else g2
    return F.when(n > 0, F.coalesce(out, F.lit(NAN)))


def aggregate(name: str, value: Column, adjust: bool = False, index: Column | None = None) -> Column:
    """The aggregate of a statistic; min and max give struct(index, value), ties the least index."""
    value = value.cast("double")
    if name == "sum":
        return F.sum(value)
    if name == "mean":
        return F.avg(value)
    if name in ("min", "max"):
        if index is None:
            raise ValueError("min and max need the index of a value")
        if name == "min":
            best = F.min(F.when(value.isNotNull(), F.struct(value.alias("v"), index.alias("i"))))
            return F.struct(best.i.alias("index"), best.v.alias("value"))
        best = F.max(F.when(value.isNotNull(), F.struct(value.alias("v"), (-index).alias("i"))))
        return F.struct((-best.i).alias("index"), best.v.alias("value"))
    return _finish(name, adjust, F.count(value), F.var_pop(value), F.skewness(value), F.kurtosis(value))


def check_adjustable(df: DataFrame, column: str, name: str) -> None:
    """Raise as the eager operators do where the adjusted statistic is undefined."""
    n = df.select(F.count(column)).first()[0]
    if n < LEAST.get(name, 1):
        raise NotAdjustable(f"{name} adjusted for bias needs {LEAST[name]} values, got {n}")


def on_columns(df: DataFrame, columns: Sequence[str], names: Sequence[str], adjust: bool = False, index: str | None = None) -> DataFrame:
    """One row per column: variable and the named statistics. One pass over the data."""
    at = F.col(index) if index else None
    cells = [aggregate(n, F.col(c), adjust, at).alias(f"{c}__{n}") for c in columns for n in names]
    return unpivot_row(df.agg(*cells), columns, names)


def on_all(df: DataFrame, columns: Sequence[str], names: Sequence[str], adjust: bool = False, row: str | None = None, n_rows: int | None = None) -> DataFrame:
    """One row: the statistics of all entries. min and max need the row number and the number of
    rows: the index is linear, column by column."""
    flat = long(df, columns, [row] if row else [])
    at = None
    if row and n_rows is not None:
        column = F.array_position(F.array(*map(F.lit, columns)), F.col("variable")) - 1
        at = F.col(row) + column * F.lit(n_rows)
    return flat.agg(*[aggregate(n, F.col("value"), adjust, at).alias(n) for n in names])


def row_statistic(name: str, columns: Sequence[str], adjust: bool = False) -> Column:
    """A statistic of a row's entries, as one expression; min and max give struct(index, value)."""
    xs = [F.col(c).cast("double") for c in columns]
    k = len(xs)
    total = fsum(xs)
    if name == "sum":
        return total
    mean = total / F.lit(float(k))
    if name == "mean":
        return mean
    if name in ("min", "max"):
        best = F.least(*xs) if name == "min" else F.greatest(*xs)
        if k == 1:
            best = xs[0]
        return F.struct((F.array_position(F.array(*xs), best) - 1).alias("index"), best.alias("value"))
    if adjust and k < LEAST.get(name, 1):
        raise NotAdjustable(f"{name} adjusted for bias needs {LEAST[name]} values, got {k}")
    n = F.lit(float(k))
    power = lambda p: fsum([F.pow(x - mean, F.lit(p)) for x in xs]) / n
    m2 = power(2.0)
    flat = m2 == 0
    g1 = F.when(flat, F.lit(None)).otherwise(F.try_divide(power(3.0), F.pow(m2, F.lit(1.5))))
    g2 = F.when(flat, F.lit(None)).otherwise(F.try_divide(power(4.0), m2 * m2) - 3)
    return _finish(name, adjust, n, m2, g1, g2)


def on_rows(df: DataFrame, columns: Sequence[str], names: Sequence[str], adjust: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """A row per row: the statistics of its entries."""
    return df.select(*keep, *[row_statistic(n, columns, adjust).alias(n) for n in names])


def covariance(df: DataFrame, columns: Sequence[str], adjust: bool = False) -> DataFrame:
    """The covariance matrix of columns as rows (i, j, variable_i, variable_j, value); one pass."""
    f = F.covar_samp if adjust else F.covar_pop
    cells = {(i, j): f(F.col(a).cast("double"), F.col(columns[j]).cast("double")) for i, a in enumerate(columns) for j in range(i, len(columns))}
    return _symmetric(df, columns, cells)


def correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson's correlations as rows; NaN wherever a variable is constant. One pass."""
    cells = {}
    for i, a in enumerate(columns):
        for j in range(i, len(columns)):
            x, y = F.col(a).cast("double"), F.col(columns[j]).cast("double")
            scale = F.sqrt(F.var_pop(x) * F.var_pop(y))
            one = F.when(F.var_pop(x) == 0, F.lit(NAN)).otherwise(F.lit(1.0))
            cells[i, j] = one if i == j else ieee_divide(F.covar_pop(x, y), scale)
    return _symmetric(df, columns, cells)


def _symmetric(df: DataFrame, columns: Sequence[str], cells: dict) -> DataFrame:
    row = df.agg(*[c.alias(f"m{i}_{j}") for (i, j), c in cells.items()])
    k = range(len(columns))
    listed = [
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(columns[i]).alias("variable_i"), F.lit(columns[j]).alias("variable_j"), F.col(f"m{min(i, j)}_{max(i, j)}").alias("value"))
        for i in k
        for j in k
    ]
    return row.select(F.explode(F.array(*listed)).alias("c")).select("c.*")


def row_covariance(coord: DataFrame, n_cols: int, adjust: bool = False) -> DataFrame:
    """Covariance between rows of a coordinate frame (i, j, v): entries (i, k, value).

    Rows are joined on their columns; quadratic in rows, as the result is.  Entries are
    centred before they are multiplied, and absent ones counted as minus the mean, so that
    large means cost no digits.
    """
    mean = coord.groupBy("i").agg((F.sum("v") / n_cols).alias("m"), F.count(F.lit(1)).alias("n"))
    centred = coord.join(mean, "i").select("i", "j", (F.col("v") - F.col("m")).alias("v"))
    a, b = centred, centred.select(F.col("i").alias("k"), "j", F.col("v").alias("w"))
    cross = a.join(b, "j").groupBy("i", "k").agg(F.sum(F.col("v") * F.col("w")).alias("s"), F.sum("v").alias("x"), F.sum("w").alias("y"), F.count(F.lit(1)).alias("both"))
    rows = mean.toDF("i", "mi", "ni").crossJoin(mean.toDF("k", "mk", "nk"))  # a row of the result each
    held = rows.join(cross, ["i", "k"], "left").fillna(0, ["s", "x", "y", "both"])
    # the first row's centred entries where the second has none, and the second's
    own = F.when(F.col("ni") > F.col("both"), F.col("mi") * (n_cols - F.col("ni")) - F.col("x")).otherwise(0.0)
    other = F.when(F.col("nk") > F.col("both"), F.col("mk") * (n_cols - F.col("nk")) - F.col("y")).otherwise(0.0)
    none = n_cols - F.col("ni") - F.col("nk") + F.col("both")
    total = F.col("s") - F.col("mk") * own - F.col("mi") * other + F.col("mi") * F.col("mk") * none
    return held.select("i", "k", (total / (n_cols - 1 if adjust else n_cols)).alias("value"))


def row_correlation(coord: DataFrame, n_cols: int) -> DataFrame:
    """Correlations between rows of a coordinate frame: (i, k, value); NaN where a row is constant."""
    c = row_covariance(coord, n_cols)
    own = c.where("i = k").select("i", F.greatest("value", F.lit(0.0)).alias("s"))
    both = c.join(own, "i").join(own.select(F.col("i").alias("k"), F.col("s").alias("t")), "k")
    return both.select("i", "k", F.when(F.col("s") * F.col("t") == 0, F.lit(NAN)).otherwise(F.try_divide("value", F.sqrt(F.col("s") * F.col("t")))).alias("value"))


#: Half the width, in probability, of the bracket in which an order statistic is looked for, and the sketch's accuracy.
_BRACKET, _ACCURACY = 0.0005, 10_000
#: Values of a bracket that are ordered in one task; larger brackets are narrowed first.  Groups of _SMALL values are one bracket.
_INSIDE, _SMALL = 100_000, 5000
#: Rounds of narrowing; a bracket that is still larger then is ordered as it is.
_ROUNDS = 10
#: Groups whose brackets are broadcast; with more of them they are joined.
_GROUPS = 10_000


def _probabilities(probabilities: Sequence[float]) -> list[float]:
    if any(not 0 <= p <= 1 for p in probabilities):
        raise ValueError("probabilities must lie in [0, 1]")
    return [float(p) for p in probabilities]


def _type8(n: Column | int, p: float) -> Column:
    """The place, in 1 to n, that a type 8 quantile interpolates at."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.greatest(F.lit(1.0), F.least((n + 1 / 3) * p + 1 / 3, n.cast("double")))


def _ordered(inside: DataFrame, keys: Sequence[str], of: DataFrame) -> DataFrame:
    """Quantiles from the values in the brackets: inside (keys, _k, _v); of (keys, _k, _h, _n, _below).

    Distinct values are counted before a bracket, of _INSIDE values at most, is ordered in a task.
    """
    counted = inside.groupBy(*keys, "_k", "_v").agg(F.count(F.lit(1)).alias("_c"))
    named = of.select(*[F.col(k).alias(f"_of{i}") for i, k in enumerate(keys)], F.col("_k").alias("_kk"), "_h", "_n", "_below")
    same = [F.col(k).eqNullSafe(F.col(f"_of{i}")) for i, k in enumerate(keys)] + [F.col("_k") == F.col("_kk")]
    w = Window.partitionBy(*keys, "_k").orderBy("_v")
    ranked = counted.withColumn("_to", F.sum("_c").over(w)).join(named, same).withColumn("_to", F.col("_to") + F.col("_below"))
    ranked = ranked.withColumn("_r", F.floor("_h"))
    holds = lambda r: (F.col("_to") - F.col("_c") < r) & (F.col("_to") >= r)
    found = ranked.groupBy(*keys, "_k").agg(
        F.max(F.when(holds(F.col("_r")), F.col("_v"))).alias("_a"),
        F.max(F.when(holds(F.least(F.col("_r") + 1, F.col("_n"))), F.col("_v"))).alias("_b"),
        F.first(F.col("_h") - F.col("_r")).alias("_f"),
    )
    return found.select(*keys, "_k", (F.col("_a") + F.col("_f") * (F.col("_b") - F.col("_a"))).alias("quantile"))


def quantile_columns(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Type 8 quantiles of each column: variable, probability, quantile. Exact, in a few passes over the wide rows.

    Sketches bracket the order statistics; a pass counts what lies below and inside each
    bracket, one with too many values is narrowed by a sketch of what it holds, and at
    the end only rows inside a bracket are brought out and ordered.  The driver holds a
    bracket for each column and probability.
    """
    probs = _probabilities(probabilities)
    x = {c: F.col(c).cast("double") for c in columns}
    clip = lambda p: max(0.0, min(1.0, p))
    edges = F.array(*[F.lit(clip(p + d)) for p in probs for d in (-_BRACKET, _BRACKET)])
    first = df.agg(*[a for i, c in enumerate(columns) for a in (F.count(x[c]).alias(f"n{i}"), F.min(x[c]).alias(f"l{i}"), F.max(x[c]).alias(f"h{i}"), F.percentile_approx(x[c], edges, _ACCURACY).alias(f"q{i}"))]).first()
    # of each column and probability: the bracket lo to hi that is counted, and one, least to most, that surely holds it
    held = {}
    for i, _ in enumerate(columns):
        if n := first[f"n{i}"]:
            for k in range(len(probs)):
                lo, hi = (first[f"l{i}"], first[f"h{i}"]) if n <= _SMALL else first[f"q{i}"][2 * k : 2 * k + 2]
                held[i, k] = {"lo": lo, "hi": hi, "least": first[f"l{i}"], "most": first[f"h{i}"], "n": n}
    place = lambda i, k: max(1.0, min((held[i, k]["n"] + 1 / 3) * probs[k] + 1 / 3, float(held[i, k]["n"])))
    within = lambda i, k: (x[columns[i]] >= held[i, k]["lo"]) & (x[columns[i]] <= held[i, k]["hi"])
    open_ = list(held)
    for round_ in range(_ROUNDS + 1):
        if not open_:
            break
        if round_ == _ROUNDS:
            for ik in open_:
                held[ik]["lo"], held[ik]["hi"] = held[ik]["least"], held[ik]["most"]
        cells = [c for i, k in open_ for c in (F.sum((x[columns[i]] < held[i, k]["lo"]).cast("long")), F.sum(within(i, k).cast("long")))]
        row = df.agg(*[c.alias(f"c{j}") for j, c in enumerate(cells)]).first()
        again, wide = [], []
        for j, (i, k) in enumerate(open_):
            b, r = held[i, k], int(place(i, k))
            b["below"], b["inside"] = row[2 * j], row[2 * j + 1]
            low, high, second = b["below"], b["below"] + b["inside"], min(r + 1, b["n"])
            if r > low and second <= high:
                if round_ == _ROUNDS or b["inside"] <= _INSIDE or b["lo"] == b["hi"]:
                    continue
                b["least"], b["most"] = b["lo"], b["hi"]
                wide.append((i, k))
            else:  # the sketch missed it
                if second <= low:
                    b["most"] = b["lo"]
                elif r > high:
                    b["least"] = b["hi"]
                b["lo"], b["hi"] = b["least"], b["most"]
            again.append((i, k))
        if wide:
            cut = lambda i, k, d: F.lit(clip((place(i, k) - held[i, k]["below"]) / held[i, k]["inside"] + d))
            sketches = [F.percentile_approx(F.when(within(i, k), x[columns[i]]), F.array(cut(i, k, -_BRACKET), cut(i, k, _BRACKET)), _ACCURACY).alias(f"s{j}") for j, (i, k) in enumerate(wide)]
            row = df.agg(*sketches).first()
            for j, ik in enumerate(wide):
                held[ik]["lo"], held[ik]["hi"] = row[j]
        open_ = again
    spark = df.sparkSession
    known = [(columns[i], k, place(i, k), b["n"], b["below"]) for (i, k), b in held.items()]
    of = spark.createDataFrame(known, "variable string, _k int, _h double, _n long, _below long")
    inside = F.array_compact(F.array(*[F.when(within(i, k), F.struct(F.lit(columns[i]).alias("variable"), F.lit(k).alias("_k"), x[columns[i]].alias("_v"))) for i, k in held])) if held else F.array()
    if not held:
        return spark.createDataFrame([], "variable string, probability double, quantile double")
    anywhere = within(*next(iter(held)))
    for i, k in held:
        anywhere = anywhere | within(i, k)
    flat = df.where(anywhere).select(F.explode(inside).alias("_p")).select("_p.*")
    prob = F.get(F.array(*map(F.lit, probs)), F.col("_k")).alias("probability")
    return _ordered(flat, ["variable"], of).select("variable", prob, "quantile")


def quantile(df: DataFrame, value: str, probabilities: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """Type 8 quantiles per group: groups..., probability, quantile. Exact, in a few passes.

    As for columns, with brackets by group in a table: broadcast where there are few
    groups, joined otherwise.  No task orders more than _INSIDE distinct values of a group.
    """
    probs = _probabilities(probabilities)
    if not groups:
        return quantile_columns(df.select(F.col(value).alias("value")), ["value"], probs).drop("variable")
    keys, many = [f"_g{i}" for i in range(len(groups))], range(len(probs))
    data = df.select(*[F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)], F.col(value).cast("double").alias("_v")).where("_v is not null")
    clip = lambda p: max(0.0, min(1.0, p))
    edges = F.array(*[F.lit(clip(p + d)) for d in (-_BRACKET, _BRACKET) for p in probs])
    sketch = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.percentile_approx("_v", edges, _ACCURACY).alias("_q"))
    border = lambda small, at: F.when(F.col("_n") <= _SMALL, F.array_repeat(small, len(probs))).otherwise(F.slice("_q", at, len(probs)))
    fields = ("_n", "_lo", "_hi", "_least", "_most")
    brackets = sketch.select(*keys, "_n", border("_min", 1).alias("_lo"), border("_max", len(probs) + 1).alias("_hi"), F.array_repeat("_min", len(probs)).alias("_least"), F.array_repeat("_max", len(probs)).alias("_most"))

    def beside(rows: DataFrame, few: DataFrame) -> DataFrame:
        """Rows with their group's bracket."""
        named = few.withColumnsRenamed({k: f"{k}_b" for k in keys})
        return rows.join(named, [F.col(k).eqNullSafe(F.col(f"{k}_b")) for k in keys]).drop(*[f"{k}_b" for k in keys])

    def settled(few: DataFrame) -> DataFrame:
        """The table with its lineage cut, and marked for broadcast if it is small."""
        held = few.limit(_GROUPS + 1).collect()
        return F.broadcast(df.sparkSession.createDataFrame(held, few.schema)) if len(held) <= _GROUPS else cut_lineage(few)

    at = lambda c, k: F.get(c, F.lit(k))
    within = lambda k: (F.col("_v") >= at("_lo", k)) & (F.col("_v") <= at("_hi", k))
    place = F.array(*[_type8(F.col("_n"), p) for p in probs])
    r, low, high = (lambda k: F.floor(at("_h", k))), (lambda k: at("_below", k)), (lambda k: at("_below", k) + at("_inside", k))
    second = lambda k: F.least(r(k) + 1, F.col("_n"))
    holds = [(r(k) > low(k)) & (second(k) <= high(k)) for k in many]
    done = [holds[k] & ((at("_inside", k) <= _INSIDE) | (at("_lo", k) == at("_hi", k))) for k in many]
    each = lambda f: F.array(*[f(k) for k in many])
    for round_ in range(_ROUNDS + 1):
        if round_ == _ROUNDS:
            brackets = brackets.withColumns({"_lo": F.col("_least"), "_hi": F.col("_most")})
        counted = beside(data, settled(brackets)).groupBy(*keys).agg(
            *[F.first(c).alias(c) for c in fields],
            each(lambda k: F.sum((F.col("_v") < at("_lo", k)).cast("long"))).alias("_below"),
            each(lambda k: F.sum(within(k).cast("long"))).alias("_inside"),
        )
        counted = settled(counted.withColumn("_h", place))
        left = counted.agg(*[F.max((~done[k]).cast("int")) for k in many], *[F.max((holds[k] & ~done[k]).cast("int")) for k in many]).first()
        if round_ == _ROUNDS or not any(left):
            break
        # a bracket that holds its place is sure; one that missed it tells on which side it lies
        sure = counted.select(
            *keys, *[c for c in fields if c == "_n"], "_lo", "_hi", "_below", "_inside", "_h", F.array(*done).alias("_done"), F.array(*holds).alias("_holds"),
            each(lambda k: F.when(holds[k], at("_lo", k)).when(r(k) > high(k), at("_hi", k)).otherwise(at("_least", k))).alias("_least"),
            each(lambda k: F.when(holds[k], at("_hi", k)).when(second(k) <= low(k), at("_lo", k)).otherwise(at("_most", k))).alias("_most"),
        )
        moved = sure.withColumns({"_lo": each(lambda k: F.when(at("_done", k), at("_lo", k)).otherwise(at("_least", k))), "_hi": each(lambda k: F.when(at("_done", k), at("_hi", k)).otherwise(at("_most", k)))})
        if any(left[len(probs) :]):
            grid = F.array(*[F.lit(j / 100) for j in range(101)])
            narrow = lambda k: at("_holds", k) & ~at("_done", k)
            kept = ("_n", "_lo", "_hi", "_least", "_most", "_below", "_inside", "_h", "_holds", "_done")
            cuts = beside(data, settled(moved)).groupBy(*keys).agg(*[F.first(c).alias(c) for c in kept], *[F.percentile_approx(F.when(within(k) & narrow(k), F.col("_v")), grid, _ACCURACY).alias(f"_s{k}") for k in many])
            step = lambda k: F.floor((at("_h", k) - at("_below", k)) / at("_inside", k) * 100).cast("int")
            cut = lambda k, d, old: F.when(narrow(k), F.get(F.col(f"_s{k}"), F.greatest(F.lit(0), F.least(step(k) + d, F.lit(100))))).otherwise(at(old, k))
            moved = cuts.withColumns({"_lo": each(lambda k: cut(k, -1, "_lo")), "_hi": each(lambda k: cut(k, 2, "_hi"))})
        brackets = moved.select(*keys, *fields)
    anywhere = within(0)
    for k in many:
        anywhere = anywhere | within(k)
    inside = beside(data, counted).where(anywhere).select(*keys, "_v", F.explode(F.array_compact(F.array(*[F.when(within(k), F.lit(k)) for k in many]))).alias("_k"))
    of = counted.select(*keys, "_n", F.posexplode(F.arrays_zip("_h", "_below")).alias("_k", "_z")).select(*keys, "_k", F.col("_z._h").alias("_h"), "_n", F.col("_z._below").alias("_below"))
    prob = F.get(F.array(*map(F.lit, probs)), F.col("_k")).alias("probability")
    return _ordered(inside, keys, of).select(*[F.col(k).alias(g) for g, k in zip(groups, keys, strict=True)], prob, "quantile")


def row_quantile(columns: Sequence[str], probability: float) -> Column:
    """The type 8 quantile of a row's entries."""
    if not 0 <= probability <= 1:
        raise ValueError("probabilities must lie in [0, 1]")
    n = len(columns)
    h = max(1.0, min(float(n), (n + 1 / 3) * probability + 1 / 3))
    r = int(h)
    ordered = F.array_sort(F.array(*[F.col(c).cast("double") for c in columns]))
    a, b = F.get(ordered, F.lit(r - 1)), F.get(ordered, F.lit(min(r, n - 1)))
    return a + (h - r) * (b - a)


def sort_entries(df: DataFrame, value: str, index: str, descending: bool = False) -> DataFrame:
    """All entries in order: position, index (where each was), value; ties by the least index."""
    listed = df.select(F.col(index).alias("index"), F.col(value).alias("value"))
    by = F.col("value").desc() if descending else F.col("value").asc()
    return with_row_id(listed, [by, F.col("index").asc()], "position").select("position", "index", "value")


def sort_index(df: DataFrame, value: str, index: str, descending: bool = False) -> DataFrame:
    """position, index: where the sorted entries were."""
    return sort_entries(df, value, index, descending).select("position", "index")


def weighted_moments(df: DataFrame, columns: Sequence[str], weight: str) -> DataFrame:
    """Per column: variable, mean and variance under weights that are normalised to 1.

    Sums are of deviations from one of the column's values, which keeps digits.
    """
    w = F.col(weight).cast("double")
    some = df.select([F.first(F.col(c).cast("double"), True) for c in columns]).first()
    cells = []
    for c, at in zip(columns, some, strict=True):
        x = F.col(c).cast("double") - F.lit(float(at or 0.0))
        m = F.sum(w * x) / F.sum(w)
        cells += [(m + F.lit(float(at or 0.0))).alias(f"{c}__mean"), (F.sum(w * x * x) / F.sum(w) - m * m).alias(f"{c}__variance")]
    return unpivot_row(df.agg(*cells), columns, ["mean", "variance"])


__all__ = ["INF", "NAN", "STATISTICS", "NotAdjustable", "aggregate", "check_adjustable", "correlation", "covariance", "on_all", "on_columns", "on_rows", "quantile", "quantile_columns", "row_correlation", "row_covariance", "row_quantile", "row_statistic", "sort_entries", "sort_index", "weighted_moments"]
