"""Language identification by a byte convolutional network.

Filters of several widths over fixed-length byte windows, max pooling and softmax,
trained in numpy on a bounded sample of labelled rows.  Training and prediction read whole
texts: consecutive windows tile them (each looks ahead into the next, so no position is
lost at a border); in a prediction the windows' logits are averaged by their share of the
bytes.

Cases: null text or text without any letter (of Unicode's categories L) gives `und` with
score 1; without any labelled row every other text is `und` with score 0; with one
language all texts get it; rows with null ids keep their row, and are trained on as well;
extra columns are ignored; repeated rows each get a row, and are trained on once; equal
scores go to the first language by name; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytecnn import ByteCNN, logits, pooled, softmax, train, windows_of
from .common import map_arrow, weighted_sample
from .texthash import buffer_of

#: Positions of a window.
SIZE = 256
#: Labelled rows used per language, at most.
BOUND = 400

#: Letters fold to lower case; other ASCII bytes say nothing of the language.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[0] = 0


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def fit(labelled: DataFrame, bound: int = BOUND) -> tuple[ByteCNN | None, list[str]]:
    """Train on labelled (doc_id, text, lang): all windows of a bounded sample of rows of each language."""
    known = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    rows, _ = weighted_sample(known, ["doc_id", "text"], bound, "lang")
    got = sorted((r.lang, r.text) for r in rows.select("lang", "text").collect() if has_letter(r.text))
    names = sorted({x[0] for x in got})
    if len(names) < 2:
        return None, names
    raw, offsets = buffer_of(pa.array([x[1] for x in got]))
    widths = (6, 4, 2)
    windows, row, _ = windows_of(_FOLD[raw], offsets, SIZE, SIZE, max(widths) - 1)
    labels = np.array([names.index(x[0]) for x in got])[row]
    return train(windows, labels, len(names), widths), names


def identify(docs: DataFrame, net: ByteCNN | None, names: list[str]) -> DataFrame:
    """docs (doc_id, text) -> doc_id, lang_pred, score."""
    tables = docs.sparkSession.sparkContext.broadcast(net.tables()) if net else None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("text")
        lettered = np.array([has_letter(t) for t in column.to_pylist()], bool)
        raw, offsets = buffer_of(column)
        if net is None:
            lang = np.where(lettered, names[0] if names else "und", "und")
            score = np.where(lettered, 1.0 if names else 0.0, 1.0)
        elif len(lettered):
            windows, row, own = windows_of(_FOLD[raw], offsets, SIZE, SIZE, net.reach)
            weight = np.maximum(own, 1)
            z = logits(net, pooled(net, tables.value, windows)) * weight[:, None]
            first = np.searchsorted(row, np.arange(len(lettered)))
            p = softmax(np.add.reduceat(z, first, axis=0) / np.add.reduceat(weight, first)[:, None])
            lang = np.where(lettered, np.array(names, object)[p.argmax(axis=1)], "und")
            score = np.where(lettered, np.clip(p.max(axis=1), 0, 1), 1.0)
        else:
            lang, score = np.array([], object), np.array([], float)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(lang.tolist(), pa.string()), pa.array(score.astype(float))], ["doc_id", "lang_pred", "score"]
        )

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double", rows=500)
