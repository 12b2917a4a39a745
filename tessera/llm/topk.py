"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer weights.  Queries are dealt in blocks of a bounded
size; for each block one pass over all vectors runs, to whose tasks the block is sent, and
which is over, its result written and the block forgotten, before the next begins.  Each
task turns a block of its candidates into posting lists (per term the candidates that
hold it, and their weights), adds the queries' weighted postings to dense score arrays
(scattered where the list is sparse, in one sweep where most candidates hold the term),
selects each query's best by partition and merges them into its running best.  What
leaves a task is k rows a query.

Cases: vectors that are null or hold a null or non-finite component take no part, nor
do rows with null ids; vectors of unequal length score over the terms they share; empty
vectors score 0; rows that repeat a query's id are no candidates of it; all rows of a
repeated query id are asked, and their scores ranked together (a repeated row gives its
scores as often as it stands there); a repeated candidate is as many candidates; ties go
to the smaller id; extra columns are ignored; an empty table gives no rows.  Scores are
exact up to 64 bits; a score beyond them raises an OverflowError.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_materialized, materialize, shared_dir

#: Weights of a block of queries (sent to every task, 8 bytes each).
BLOCK_WEIGHTS = 1 << 21
#: Queries and candidates of a score array.
QUERY_ROWS, CANDIDATES = 32, 4096
#: Candidates of a task, at least, where there are more tasks than cores.
TASK_ROWS = 20_000
#: Share of the candidates from which a posting list is added in one sweep.
DENSE = 0.25


def weights_of(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with only finite components: their numbers, and floor(scale * x) padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    sizes = np.array([-1 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()], np.int64)
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    fine = np.isfinite(values)
    bad = np.concatenate([[0], np.cumsum(~fine)])
    keep = np.flatnonzero((sizes >= 0) & (bad[starts + np.maximum(sizes, 0)] == bad[starts]))
    width = int(sizes[keep].max()) if len(keep) else 0
    found = np.zeros((len(keep), width))
    for n in np.unique(sizes[keep]):
        at = np.flatnonzero(sizes[keep] == n)
        found[at, :n] = values[starts[keep[at]][:, None] + np.arange(n)]
    return keep, np.floor(found * scale)


def _exact_kind(queries: np.ndarray, candidates: np.ndarray) -> type:
    """The narrowest type that holds all weights and scores: 32 or 64 bits, or Python's integers."""
    q, c = float(np.abs(queries).max(initial=0)), float(np.abs(candidates).max(initial=0))
    most = max(q * c * max(1, min(queries.shape[1], candidates.shape[1])), q, c)
    return np.int32 if most < 2**31 - 1 else np.int64 if most < 2**62 else object


def _by_term(rows: np.ndarray, terms: int, kind: type) -> np.ndarray:
    """Weights (terms x rows) as exact integers."""
    flat = np.ascontiguousarray(rows[:, :terms].T)
    return np.vectorize(int, otypes=[object])(flat) if kind is object and flat.size else flat.astype(kind)


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores (queries x candidates), term at a time over the posting lists."""
    terms, kind = min(queries.shape[1], candidates.shape[1]), _exact_kind(queries, candidates)
    return _accumulated(_by_term(queries, terms, kind), _by_term(candidates, terms, kind))


def _accumulated(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """The same from weights by term (terms x queries, terms x candidates)."""
    scores = np.zeros((queries.shape[1], candidates.shape[1]), queries.dtype)
    part = np.empty_like(scores)
    for asked, held in zip(queries, candidates, strict=True):
        posting = np.flatnonzero(held)
        if len(posting) >= DENSE * len(held):
            np.multiply(asked[:, None], held[None, :], out=part)
            np.add(scores, part, out=scores)
        elif len(posting):
            asking = np.flatnonzero(asked)
            scores[np.ix_(asking, posting)] += np.multiply.outer(asked[asking], held[posting])
    return scores


_NONE = np.iinfo(np.int64).min


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's k best (scores, ids), ties to the smaller id; ids are ascending."""
    n = scores.shape[1]
    if n > k:
        # all above the k-th score, and of those at it the first by id
        kth = np.partition(scores, n - k, axis=1)[:, n - k][:, None]
        above = scores > kth
        level = scores == kth
        room = k - above.sum(axis=1, keepdims=True)
        pick = above | (level & (np.cumsum(level, axis=1) <= room))
        at = np.nonzero(pick)[1].reshape(len(scores), k)
    else:
        at = np.broadcast_to(np.arange(n), scores.shape)
    return np.take_along_axis(scores, at, axis=1), ids[at]


def _as_long(scores: np.ndarray) -> np.ndarray:
    """Scores of any exact kind in 64 bits."""
    if scores.dtype == object and scores.size and max(scores.max(), -scores.min()) >= 2**63:
        raise OverflowError("an inner product is beyond 64 bits")
    return scores.astype(np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64) -> DataFrame:
    """vectors and queries (vec_id, embedding) -> query_id, rank, vec_id, score: each query's k best.

    The score is the inner product of floor(scale * x) over the components.
    """
    spark = vectors.sparkSession
    listed = lambda df: df.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    vectors = listed(vectors)
    asked = materialize(listed(queries).groupBy("vec_id", "embedding").agg(F.count(F.lit(1)).alias("times")), "queries")
    n, width = asked.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    # a quarter of a block's weights is room for uneven hashing
    blocks = max(1, -(-n * max(1, width or 0) * 5 // (BLOCK_WEIGHTS * 4)))
    tasks = max(spark.sparkContext.defaultParallelism, vectors.count() // TASK_ROWS)
    dealt = vectors.coalesce(tasks)
    path = f"{shared_dir(spark)}/best-{uuid.uuid4().hex}"
    schema = "query_id long, times long, vec_id long, score long"
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)) == block).toArrow().combine_chunks()
        held = rows.column("embedding").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.float64()))
        keep, weights = weights_of(held, scale)
        ids, times = (rows.column(c).to_numpy()[keep] for c in ("vec_id", "times"))
        spread = spark.sparkContext.broadcast((ids, times, weights))
        dealt.mapInArrow(_search(spread, k, scale), schema).write.mode("append").parquet(path)
        spread.destroy()
    found = spark.read.schema(schema).parquet(path)
    found = found.withColumn("again", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(k))))).drop("times", "again")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    result = materialize(best, "topk")
    drop_materialized(asked)
    drop_materialized(found)
    return result


def _search(spread, k: int, scale: int):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, times, weights = spread.value
        if not len(asked):
            return
        scores = np.full((len(asked), k), _NONE)
        held = np.full((len(asked), k), np.iinfo(np.int64).max)
        by_term: dict = {}  # the queries' weights by term, of each kind in use
        for batch in batches:
            for lo in range(0, batch.num_rows, CANDIDATES):
                part = batch.slice(lo, CANDIDATES)
                keep, own = weights_of(part.column("embedding"), scale)
                ids = part.column("vec_id").to_numpy()[keep]
                order = np.argsort(ids, kind="stable")
                ids, own = ids[order], own[order]
                if not len(ids):
                    continue
                kind, terms = _exact_kind(weights, own), min(weights.shape[1], own.shape[1])
                if kind not in by_term:
                    by_term[kind] = _by_term(weights, weights.shape[1], kind)
                own = _by_term(own, terms, kind)
                for a in range(0, len(asked), QUERY_ROWS):
                    z = a + QUERY_ROWS
                    got = _accumulated(by_term[kind][:terms, a:z], own)
                    none = -(2**63) if kind is object else np.iinfo(kind).min
                    same = asked[a:z, None] == ids[None, :]
                    if same.any():
                        got[same] = none
                    s, i = best_of(got, ids, k)
                    s = np.where(s == none, _NONE, _as_long(np.where(s == none, 0, s)))
                    s, i = np.concatenate([scores[a:z], s], axis=1), np.concatenate([held[a:z], i], axis=1)
                    order = np.lexsort((i, -np.maximum(s, _NONE + 1)), axis=-1)[:, :k]  # no 64-bit integer is -_NONE
                    scores[a:z], held[a:z] = np.take_along_axis(s, order, axis=1), np.take_along_axis(i, order, axis=1)
        q, place = np.nonzero(scores != _NONE)
        yield pa.RecordBatch.from_arrays(
            [pa.array(asked[q]), pa.array(times[q]), pa.array(held[q, place]), pa.array(scores[q, place])], ["query_id", "times", "vec_id", "score"]
        )

    return run
