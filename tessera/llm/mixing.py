"""Mixing sources to target weights by temperature.

Source shares of tokens are raised to an exponent and normalised.  The exponent is
narrowed down between 1 (as it is) and 0 (all sources alike): it is the least change that
reaches the target entropy, held back where a source would be repeated more often than
allowed.  Weights times the budget give each source's tokens; they are realised as
blocks: each block is a keyed permutation of the source's documents, all but the last
are whole, and of the last a beginning is taken up to the source's budget.

The end of that beginning is found without ordering a source in one task: the documents'
keys are summed by their first bits, then within the one range where the budget ends by
the bits that follow, until few documents are left in it.

Cases: null text has 0 tokens and no place in the mix, empty texts likewise; null source
is the source ''; repeated rows are documents of their own, also where the budget ends
among them; very long texts count as any other, so that a budget may be exceeded by the
last one's size; equal keys are ordered by a second hash; extra columns stay, and columns
of docs named block or place come back as block_in and place_in; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_materialized, materialize

#: Documents of the range in which a budget ends that are ordered in one task; bits by which a range is narrowed, and of a key.
RANGE_ROWS, STEP_BITS, KEY_BITS = 2000, 10, 63


def tokens_of(text: str = "text") -> Column:
    """The estimate of a text's tokens: a token for every four bytes begun."""
    return F.coalesce(F.ceil(F.octet_length(F.col(text)) / F.lit(4.0)).cast("long"), F.lit(0).cast("long"))


def _curves(shares: DataFrame, total: int, budget: float, exponents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy and most repetitions of the mix at each exponent; one pass over the sources for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, logs, most = (np.zeros(len(exponents)) for _ in range(3))
        for batch in batches:
            tokens = batch.column("tokens").to_numpy(zero_copy_only=False).astype(float)
            for lo in range(0, len(tokens), 1000):
                t = tokens[lo : lo + 1000, None]
                log = np.log(t / total)
                power = np.exp(log * exponents)
                sums += power.sum(axis=0)
                logs += (power * log).sum(axis=0)
                most = np.maximum(most, (power / t).max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(exponents), dtype=np.int32)), pa.array(sums), pa.array(logs), pa.array(most)], ["k", "z", "l", "m"])

    held = shares.select("tokens").mapInArrow(run, "k int, z double, l double, m double")
    rows = held.groupBy("k").agg(F.sum("z"), F.sum("l"), F.max("m")).collect()  # a row for each exponent
    z, log, m = np.array([tuple(r)[1:] for r in sorted(rows)]).T
    return np.log(z) - exponents * log / z, budget * m / z


def exponent(shares: DataFrame, target: float, repeats: float, budget: float | None = None, rounds: int = 4, grid: int = 256) -> float:
    """The greatest exponent in [0, 1] whose mix has the target share of the greatest entropy,
    or the least one that keeps every source within `repeats` repetitions, whichever is greater.

    shares (source, tokens > 0). Each round narrows both brackets to one of `grid` steps;
    only sums over sources reach the driver.
    """
    n, total = shares.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    if not n or n < 2:
        return 1.0
    budget, goal = float(budget or total), target * np.log(n)
    by_entropy, by_limit = (0.0, 1.0), (0.0, 1.0)  # entropy falls and repetitions fall as the exponent rises
    for _ in range(rounds):
        points = [np.linspace(*bracket, grid + 1) for bracket in (by_entropy, by_limit)]
        entropy, most = _curves(shares, total, budget, np.concatenate(points))
        # the greatest point that meets the goal, the least point within the limit
        k = max(np.flatnonzero(entropy[: grid + 1] >= goal - 1e-12), default=0)
        by_entropy = points[0][k], points[0][min(k + 1, grid)]
        k = min(np.flatnonzero(most[grid + 1 :] <= repeats), default=grid)
        by_limit = points[1][max(k - 1, 0)], points[1][k]
    return float(max(by_entropy[0], by_limit[1]))


def weights(docs: DataFrame, target: float = 0.97, repeats: float = 4.0, budget: int | None = None) -> DataFrame:
    """Per source: source, documents, tokens, share, weight, exponent, quota (tokens), blocks (quota / tokens)."""
    counted = docs.select(F.coalesce("source", F.lit("")).alias("source"), tokens_of().alias("tokens")).where("tokens > 0")
    shares = materialize(counted.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens")), "shares")
    total = shares.agg(F.sum("tokens")).first()[0] or 0
    power = exponent(shares, target, repeats, budget)
    p = F.col("tokens") / F.lit(float(total or 1))
    z = shares.agg(F.sum(F.pow(p, F.lit(power)))).first()[0] or 1.0
    weight = F.pow(p, F.lit(power)) / F.lit(z)
    out = shares.select("source", "documents", "tokens", p.alias("share"), weight.alias("weight"), F.lit(power).alias("exponent"))
    # a budget beyond the repetition limit of every mix is cut per source
    quota = F.least(F.floor(F.col("weight") * F.lit(budget or total)).cast("long"), F.floor(F.col("tokens") * F.lit(repeats)).cast("long"))
    result = materialize(out.withColumn("quota", quota).withColumn("blocks", F.col("quota") / F.col("tokens")), "mix")
    drop_materialized(shares)
    return result


def keyed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Documents with tokens: row (a struct of all columns), source, tokens, hash, key, tie.

    key and tie order the documents of the last, partial block; equal rows have equal ones.
    """
    kinds = dict(docs.dtypes)
    held = [F.col(f"`{c}`") for c in docs.columns]
    hashed = [F.to_json(F.struct(c)) if "map<" in kinds[name] else c for name, c in zip(docs.columns, held, strict=True)]
    rows = docs.select(F.struct(*held).alias("row"), F.coalesce("source", F.lit("")).alias("source"), tokens_of().alias("tokens"), F.xxhash64(*hashed).alias("hash"), F.xxhash64(F.lit("tie"), *hashed).alias("tie"))
    return rows.where("tokens > 0").withColumn("key", _place(seed, F.lit(-1)))


def _place(seed: int, block: Column) -> Column:
    """A row's key in a block's permutation: KEY_BITS bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), block.cast("long"), F.col("hash")), 64 - KEY_BITS)


def _stops(slim: DataFrame, quotas: DataFrame) -> DataFrame:
    """Where each source's last block ends: source, stop_key, stop_tie, take, equal.

    Rows before (stop_key, stop_tie) are in it, and `take` of the `equal` rows with that key and tie.
    """
    edge = materialize(quotas.where("rest > 0").select("source", F.lit(0).cast("long").alias("range"), F.col("rest").alias("left")), "edge")
    bits = 0
    while True:
        shift = KEY_BITS - bits
        within = slim.join(edge, "source")
        if bits:
            within = within.where(F.shiftrightunsigned("key", shift) == F.col("range"))
        if bits and not edge.where(f"n > {RANGE_ROWS} and lowest < highest").limit(1).count() or bits + STEP_BITS > KEY_BITS:
            break
        bits += STEP_BITS
        sums = within.groupBy("source", F.shiftrightunsigned("key", KEY_BITS - bits).alias("range")).agg(
            F.sum("tokens").alias("sum"), F.count(F.lit(1)).alias("n"), F.min("key").alias("lowest"), F.max("key").alias("highest"), F.first("left").alias("left")
        )
        before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # 1024 rows a source at most
        placed = sums.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0)))
        now = materialize(placed.where("before < left and before + sum >= left").select("source", "range", (F.col("left") - F.col("before")).alias("left"), "n", "lowest", "highest"), "edge")
        drop_materialized(edge)
        edge = now
    alike = within.groupBy("source", "key", "tie").agg(F.first("tokens").alias("each"), F.count(F.lit(1)).alias("equal"), F.first("left").alias("left"))
    before = Window.partitionBy("source").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = alike.withColumn("before", F.coalesce(F.sum(F.col("each") * F.col("equal")).over(before), F.lit(0)))
    ends = placed.where("before < left and before + each * equal >= left")
    out = materialize(ends.select("source", F.col("key").alias("stop_key"), F.col("tie").alias("stop_tie"), F.ceil((F.col("left") - F.col("before")) / F.col("each")).cast("long").alias("take"), "equal"), "stops")
    drop_materialized(edge)
    return out


def mix(docs: DataFrame, target: float = 0.97, repeats: float = 4.0, budget: int | None = None, seed: int = 0) -> DataFrame:
    """The columns of docs, and block int, place long: one row for each time that a document is used.

    Within a source, (block, place) orders the rows; place is the document's key in the
    block's permutation.
    """
    per_source = weights(docs, target, repeats, budget)
    quotas = per_source.select("source", F.floor(F.col("quota") / F.col("tokens")).cast("int").alias("whole"), (F.col("quota") % F.col("tokens")).alias("rest"))
    rows = keyed(docs, seed)
    slim = materialize(rows.select("source", "tokens", "key", "tie"), "keys")
    stops = _stops(slim, quotas)
    plan = materialize(quotas.join(stops, "source", "left"), "plan")
    for done in (slim, stops, per_source):
        drop_materialized(done)
    full = rows.join(plan, "source")
    at_stop = (F.col("key") == F.col("stop_key")) & (F.col("tie") == F.col("stop_tie"))
    below = (F.col("key") < F.col("stop_key")) | ((F.col("key") == F.col("stop_key")) & (F.col("tie") < F.col("stop_tie")))
    copies = F.col("whole") + F.coalesce((below | (at_stop & (F.col("take") == F.col("equal")))).cast("int"), F.lit(0))
    out = full.withColumn("copies", copies).where("copies > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    if not plan.where("take < equal").isEmpty():  # a budget ends among equal rows: so many of them as fit
        some = full.where(at_stop & (F.col("take") < F.col("equal"))).dropDuplicates(["source"])
        some = some.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("take")))).withColumns({"copies": F.lit(0), "block": F.col("whole")})
        out = out.unionByName(some.select(*out.columns))
    place = F.when(F.col("block") < F.col("whole"), _place(seed, F.col("block"))).otherwise(F.col("key"))
    own = [F.col(f"row.`{c}`").alias(f"{c}_in" if c in ("block", "place") else c) for c in docs.columns]
    return out.select(*own, "block", place.alias("place"))
