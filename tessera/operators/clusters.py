"""Clusters by cross-entropy: find parts, and explain parts by few features.

Points are a bounded matrix on the driver (items are parameters of the search); the
sampled partitions may be scored on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .crossentropy import Combination, Partition, optimize


def _scatter(points: np.ndarray, states: np.ndarray, parts: int) -> np.ndarray:
    """Sum over parts of squared deviations from the part's mean, for each state."""
    total = (points**2).sum()
    out = np.full(len(states), total)
    for k in range(parts):
        own = (states == k).astype(float)
        n = own.sum(axis=1)
        out -= ((own @ points) ** 2).sum(axis=1) / np.maximum(n, 1)
    return out


def discover(points: np.ndarray, parts: int, seed: int = 0, spark: SparkSession | None = None, draws: int = 500) -> np.ndarray:
    """Part of each point, of at most `parts`, with least scatter. Parts are numbered by first point."""
    points = np.asarray(points, float)
    if not 1 < parts < len(points):
        raise ValueError("there are at least two parts, and fewer than points")
    centred = points - points.mean(axis=0)
    context = Partition(lambda s: _scatter(centred, s, parts), len(points), parts, smoothing=0.8)
    found = optimize(context, draws * parts, 0.01, seed, spark).optimal_state
    order = {p: k for k, p in enumerate(dict.fromkeys(found.tolist()))}
    return np.array([order[p] for p in found.tolist()])


def davies_bouldin(points: np.ndarray, labels: np.ndarray) -> float:
    names = np.unique(labels)
    centres = np.stack([points[labels == p].mean(axis=0) for p in names])
    spread = np.array([np.sqrt(((points[labels == p] - c) ** 2).sum(axis=1)).mean() for p, c in zip(names, centres, strict=True)])
    gap = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))
    np.fill_diagonal(gap, np.inf)
    with np.errstate(divide="ignore"):
        return float(((spread[:, None] + spread[None]) / gap).max(axis=1).mean())


#: Feature subsets that are simply enumerated.
ENUMERATED = 2000
#: Subsets scored in one pass over a table.
SCORED = 4000


def explain(points: np.ndarray, labels: np.ndarray, features: int, seed: int = 0, spark: SparkSession | None = None) -> np.ndarray:
    """The features that separate the parts best: least Davies-Bouldin index."""
    points, labels = np.asarray(points, float), np.asarray(labels)
    k = points.shape[1]
    if not 0 < features < k:
        raise ValueError("fewer features than there are explain the parts")
    subsets = combinations(range(k), features)
    if comb(k, features) <= ENUMERATED:
        return np.array(min(subsets, key=lambda s: davies_bouldin(points[:, list(s)], labels)))
    context = Combination(lambda s: np.array([davies_bouldin(points[:, x > 0], labels) for x in s]), k, features)
    return np.flatnonzero(optimize(context, 1000 * k, 0.01, seed, spark).optimal_state)


def subset_indexes(df: DataFrame, vector: str, label: str, subsets: np.ndarray) -> np.ndarray:
    """The Davies-Bouldin index of each subset (rows of feature numbers), scored on the executors.

    Means by label and feature, and summed distances by label and subset, reach the driver.
    """
    rows = df.select(F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("x"))
    means = rows.select("label", F.posexplode("x").alias("k", "v")).groupBy("label", "k").agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    names = sorted({r.label for r in means})
    place = {p: i for i, p in enumerate(names)}
    centres = np.zeros((len(names), 1 + max(r.k for r in means)))
    sizes = np.zeros(len(names))
    for r in means:
        centres[place[r.label], r.k] = r.m
        sizes[place[r.label]] = r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), len(subsets)))
        for batch in batches:
            own = np.array([place[p] for p in batch.column("label").to_pylist()], int)
            if len(own):
                square = (np.array(batch.column("x").to_pylist(), float) - centres[own]) ** 2
                for at in range(0, len(own), 200):
                    np.add.at(total, own[at : at + 200], np.sqrt(square[at : at + 200][:, subsets].sum(axis=2)))
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["part", "subset", "distance"])

    spread = np.zeros((len(names), len(subsets)))
    for r in rows.mapInArrow(run, "part int, subset int, distance double").groupBy("part", "subset").agg(F.sum("distance").alias("d")).collect():
        spread[r.part, r.subset] = r.d / sizes[r.part]
    out = np.zeros(len(subsets))
    for j, s in enumerate(subsets):
        gap = np.sqrt(((centres[:, None, s] - centres[None, :, s]) ** 2).sum(axis=2))
        np.fill_diagonal(gap, np.inf)
        with np.errstate(divide="ignore"):
            out[j] = ((spread[:, None, j] + spread[None, :, j]) / gap).max(axis=1).mean()
    return out


def explain_table(df: DataFrame, vector: str, label: str, features: int, seed: int = 0) -> np.ndarray:
    """`explain` over a table with an array column of features: no row reaches the driver.

    The cross-entropy search scores each subset once, and the best of all that it scored is the answer.
    """
    df = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull())
    k = df.select(F.max(F.size(vector))).first()[0]
    if not 0 < features < (k or 0):
        raise ValueError("fewer features than there are explain the parts")
    if comb(k, features) <= ENUMERATED:
        subsets = np.array(list(combinations(range(k), features)))
        return subsets[np.argmin(subset_indexes(df, vector, label, subsets))]
    seen: dict[tuple[int, ...], float] = {}

    def score(states: np.ndarray) -> np.ndarray:
        keys = [tuple(x) for x in np.nonzero(states > 0)[1].reshape(len(states), features).tolist()]
        fresh = sorted(set(keys) - seen.keys())
        for at in range(0, len(fresh), SCORED):
            part = fresh[at : at + SCORED]
            seen.update(zip(part, subset_indexes(df, vector, label, np.array(part)).tolist(), strict=True))
        return np.array([seen[x] for x in keys])

    optimize(Combination(score, k, features), 1000 * k, 0.01, seed)
    return np.array(min(seen, key=lambda s: (seen[s], s)))
