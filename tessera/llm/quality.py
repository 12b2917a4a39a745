"""Document quality by a byte-level convolutional network.

The network of `bytecnn` reads overlapping chunks that cover the whole document, in
training as in scoring.  Each chunk's max-pooled responses give a log-odds; mean, greatest and least log-odds of the
document's chunks and the pooled responses of the whole document (the maximum over all
chunks) are combined by a logistic layer into one probability of a good document.

Cases: null and empty texts are one chunk of padding and get a score as well; without
labelled rows of both classes every score is the share of label 1 (0.5 without any
row); rows with null ids keep their row; extra columns are ignored; repeated rows each get
a row of the same score, and are trained on once; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytecnn import ByteCNN, logits, pooled, train, windows_of
from .common import drop_materialized, labelled_sample, map_arrow
from .texthash import buffer_of

#: Positions of a chunk and the distance of two chunks.
SIZE, STEP = 512, 448
#: Labelled rows used per class, at most.
BOUND = 2000


def logistic(features: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30, rows: np.ndarray | float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept. Each row counts as so many `rows`."""
    x = np.column_stack([features, np.ones(len(features))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ ((p - y) * rows) + penalty * w
        curve = (x * (np.maximum(p * (1 - p), 1e-6) * rows)[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(curve, grad)
        w -= move * min(1, 5 / max(np.abs(move).max(), 1e-9))
    return w


def _features(net: ByteCNN, tables: list[np.ndarray], column: pa.Array) -> np.ndarray:
    """Per row: mean, max and min of the chunks' log-odds, then the rectified pooled responses."""
    raw, offsets = buffer_of(column)
    if len(offsets) < 2:
        return np.zeros((0, 3 + len(net.bias)))
    chunks, row, own = windows_of(raw, offsets, SIZE, STEP, net.reach)
    found = pooled(net, tables, chunks)
    z = logits(net, found)
    odds = z[:, 1] - z[:, 0]
    first = np.searchsorted(row, np.arange(len(offsets) - 1))
    weight = np.maximum(own, 1)
    mean = np.add.reduceat(odds * weight, first) / np.add.reduceat(weight, first)
    top, low = np.maximum.reduceat(odds, first), np.minimum.reduceat(odds, first)
    whole = np.maximum(np.maximum.reduceat(found, first, axis=0) + net.bias, 0)
    return np.column_stack([mean, top, low, whole])


def fit(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> dict:
    """Train on docs (doc_id, text) and labels (doc_id, label): filters on all chunks, the combination on whole
    documents, of a bounded sample of each class; each row counts for the rows of its class that it stands for.
    """
    rows, stands_for = labelled_sample(docs, labels, bound)
    got = sorted((r.text, r.label) for r in rows.collect())
    y = np.array([int(x[1]) for x in got])
    if len(set(y.tolist())) < 2:
        return {"net": None, "share": float(y.mean()) if len(y) else 0.5}
    raw, offsets = buffer_of(pa.array([x[0] for x in got]))
    widths = (6, 4, 2)
    windows, row, _ = windows_of(raw, offsets, SIZE, STEP, max(widths) - 1)
    net = train(windows, y[row], 2, widths, count=16, epochs=4, steps=400)
    spread = rows.sparkSession.sparkContext.broadcast((net, net.tables()))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        f = _features(*spread.value, batch.column("text"))
        return pa.RecordBatch.from_arrays([pa.array(list(f), pa.list_(pa.float64())), batch.column("label").cast(pa.int32())], ["f", "label"])

    whole = map_arrow(rows, run, "f array<double>, label int", rows=500).collect()
    drop_materialized(rows)
    features, labels = np.array([r.f for r in whole]), np.array([r.label for r in whole])
    order = np.lexsort([*features.T[:4], labels])
    features, labels = features[order], labels[order]
    centre, scale = features.mean(axis=0), features.std(axis=0) + 1e-6
    rows_of = np.array([stands_for[y] for y in labels])
    return {"net": net, "centre": centre, "scale": scale, "weights": logistic((features - centre) / scale, labels, ridge=2.0, rows=rows_of)}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score in 0 to 1."""
    net = model["net"]
    spread = docs.sparkSession.sparkContext.broadcast((net, net.tables())) if net else None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if net is None:
            p = np.full(batch.num_rows, model["share"])
        else:
            f = (_features(*spread.value, batch.column("text")) - model["centre"]) / model["scale"]
            p = 1 / (1 + np.exp(-np.clip(f @ model["weights"][:-1] + model["weights"][-1], -30, 30)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(p)], ["doc_id", "score"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double", rows=500)
