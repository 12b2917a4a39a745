"""Toxic passages: maximum-scoring segments of token log-odds, calibrated as extreme values.

A token's weight is its log-odds between toxic and clean labelled documents under a
Dirichlet prior, moved towards 0 by standard errors; what is left below a least
weight counts as none, so that common words don't add up.  Weightless tokens cost a small drift, so
that random text has a falling score.  One linear scan finds all disjoint maximal
segments.  Their significance follows the extreme-value law of maximal segment
scores: exp(-lambda S) K n, with lambda the root of E[exp(lambda s)] = 1 over clean
tokens and K fitted to the clean documents' best segments.  A document's segments are
aggregated by the sum statistic, and a logistic curve, fitted on the training rows with
each row's own counts taken out, turns it into a probability.

Cases: null and empty texts score as texts without any segment; without labelled rows
of both classes every score is the share of label 1 (0 without any row); rows with null
ids keep their row; extra columns are ignored; repeated rows each get a row of the same
score, and are trained on once; of segments that could end at several places the shortest
is taken; whole texts are read, whatever their length; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, labelled_sample, map_arrow, texts_of
from .quality import logistic

#: Labelled rows used per class, at most.
BOUND = 5000
#: Cost of a token without weight; standard errors taken off; least weight.  Of 0.02, 0.05, 0.1; 1, 1.5, 2; 1, 1.5, 2 those
#: with the least product of log losses in three-fold cross-validations inside the training rows of two labelled tables.
DRIFT, ERRORS, LEAST = 0.05, 1.5, 2.0
#: Significance of a reported passage: the expected number of such in a clean text.
EXPECTED = 0.05

_WORD = re.compile(r"[^\W\d_]+")


def _odds(toxic: float, clean: float, docs: tuple[int, int]) -> float:
    """Log-odds of a token seen in so many toxic and clean documents, moved towards 0."""
    prior = 0.5
    delta = math.log((toxic + prior) / (docs[0] + 1)) - math.log((clean + prior) / (docs[1] + 1))
    error = ERRORS * math.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
    left = abs(delta) - error
    return math.copysign(left, delta) if left >= LEAST else 0.0


class Weights:
    """Token weights; tokens without one cost the drift."""

    def __init__(self, counts: dict[str, tuple[int, int]], docs: tuple[int, int]):
        self.counts, self.docs = counts, docs
        self.known = {w: _odds(*c, docs) or -DRIFT for w, c in counts.items()}

    def scores(self, words: list[str]) -> np.ndarray:
        get = self.known.get
        return np.array([get(w, -DRIFT) for w in words])

    def without(self, words: list[str], toxic: bool) -> np.ndarray:
        """Scores of a document's words with the document itself taken out of the counts."""
        out, docs = {}, (self.docs[0] - toxic, self.docs[1] - (not toxic))
        for w in set(words):
            c = self.counts.get(w)
            out[w] = (_odds(c[0] - toxic, c[1] - (not toxic), docs) if c else 0.0) or -DRIFT
        return np.array([out[w] for w in words])


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in one linear scan (Ruzzo and Tompa)."""
    held: list[list] = []  # start, end, sum before, sum through
    total = 0.0
    at = 0
    for k in np.flatnonzero(scores > 0).tolist():
        total += float(scores[at:k].sum())
        now = [k, k + 1, total, total + float(scores[k])]
        total, at = now[3], k + 1
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= now[2]:
                j -= 1
            if j < 0 or held[j][3] >= now[3]:
                held.append(now)
                break
            now = [held[j][0], now[1], held[j][2], now[3]]
            del held[j:]
    return [(a, b, through - before) for a, b, before, through in held]


def _root(values: np.ndarray, shares: np.ndarray) -> float:
    """lambda > 0 with E[exp(lambda s)] = 1, for a score with a negative mean."""
    lo, hi = 1e-6, 1.0
    f = lambda x: float(shares @ np.exp(np.clip(x * values, -700, 700))) - 1
    while f(hi) < 0 and hi < 1e3:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def _summary(found: list[tuple[int, int, float]], n: int, rate: float, scale: float) -> tuple[float, float]:
    """Normalised score of the best segment, and the sum statistic of all that exceed chance."""
    floor = math.log(max(scale * n, 1e-9)) if n else 0.0
    normal = sorted((rate * s - floor for _, _, s in found), reverse=True)
    best = normal[0] if normal else 0.0
    top = 0.0
    total = 0.0
    for r, x in enumerate(normal, 1):
        total += x
        if x <= 0:
            break
        # -log of the tail probability of the sum of the r best: e^-T T^(r-1) / (r! (r-1)!)
        tail = total - (r - 1) * math.log(max(total, 1.0)) + math.lgamma(r + 1) + math.lgamma(r)
        top = max(top, tail)
    return max(best, 0.0), top


def _shape(best: np.ndarray, top: np.ndarray) -> np.ndarray:
    return np.column_stack([np.log1p(best), np.log1p(top)])


def _kept(token_counts: list[tuple[str, int, int]], docs_of: tuple[int, int]) -> dict[str, tuple[int, int]]:
    """Tokens (token, toxic documents, documents) that tell something in either direction: token -> (toxic, clean)."""
    rate = docs_of[0] / sum(docs_of)
    return {w: (t, n - t) for w, t, n in token_counts if n >= 3 and abs(t - n * rate) > 2 * math.sqrt(n * rate * (1 - rate))}


def _left_out(weights: Weights, text: str, toxic: bool) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """A training text's scores without its own counts, and its segments."""
    words = _WORD.findall(text.lower())
    scores = weights.without(words, toxic)
    return scores, segments(scores) if words else []


def _decay(positive: dict[float, int], loss: float, losses: int) -> float:
    """The law's lambda, from how often each positive score occurs in clean texts and the sum of the others."""
    values = np.array([*sorted(positive), loss / max(1, losses)])
    shares = np.array([*(positive[v] for v in sorted(positive)), max(1, losses)], float)
    shares /= shares.sum()
    found = _root(values, shares) if float(shares @ values) < 0 else 1e-3
    return min(found, 1.0)  # log-odds are in natural units already


def _curve(stats: list[tuple[int, float, float]], stands_for: dict) -> np.ndarray:
    """The logistic curve over (label, best, sum statistic) of the training texts."""
    stats = sorted(stats)
    y = np.array([s[0] for s in stats])
    rows_of = np.array([stands_for[s[0]] for s in stats])
    features = _shape(np.array([s[1] for s in stats]), np.array([s[2] for s in stats]))
    return logistic(features, y, ridge=0.1, rows=rows_of) if 0 < y.sum() < len(y) else np.zeros(3)


def fit(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> dict:
    """Train on docs (doc_id, text) and labels (doc_id, label), a bounded sample of each class.

    In the logistic curve a sampled row counts for all rows of its class that it stands
    for, so that the scores hold for the true share of toxic texts at every size.
    Counting and scoring run on the executors over the sample alone; what reaches the
    driver are its telling tokens, how often each score occurs (in steps of 1/1000), and
    two numbers a sampled row.
    """
    rows, stands_for = labelled_sample(docs, labels, bound)

    def tokens(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, label = [], []
        for text, y in zip(texts_of(batch), batch.column("label").to_pylist(), strict=True):
            parts = set(_WORD.findall(text.lower()))
            parts.add("")  # counts the documents
            found += parts
            label += [y] * len(parts)
        return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(label, pa.int32())], ["token", "label"])

    counted = map_arrow(rows, tokens, "token string, label int", rows=200).groupBy("token").agg(F.sum(F.col("label").cast("long")).alias("t"), F.count(F.lit(1)).alias("n"))
    held = [(r.token, r.t, r.n) for r in counted.where("token = '' or n >= 3").collect()]
    number = next(((t, n) for w, t, n in held if not w), (0, 0))
    docs_of = (number[0], number[1] - number[0])
    if not all(docs_of):
        drop_materialized(rows)
        return {"share": docs_of[0] / max(1, sum(docs_of))}
    weights = Weights(_kept([x for x in held if x[0]], docs_of), docs_of)
    spread = docs.sparkSession.sparkContext.broadcast((weights.counts, docs_of))

    def of_clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, values, counts = Weights(*spread.value), [], []
        for text in texts_of(batch):
            scores = np.round(_left_out(own, text, False)[0], 3)
            v, c = np.unique(scores, return_counts=True)
            values += v.tolist()
            counts += c.tolist()
        return pa.RecordBatch.from_arrays([pa.array(values, pa.float64()), pa.array(counts, pa.int64())], ["v", "n"])

    told = map_arrow(rows.where("label = 0"), of_clean, "v double, n long", rows=200).groupBy("v").agg(F.sum("n").alias("n")).collect()
    below = [(r.v, r.n) for r in told if r.v < 0]
    decay = _decay({r.v: r.n for r in told if r.v > 0}, sum(v * n for v, n in below), sum(n for _, n in below))

    def of_best(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, found = Weights(*spread.value), []
        for text in texts_of(batch):
            scores, held = _left_out(own, text, False)
            found.append(len(scores) * math.exp(-decay * max((s for _, _, s in held), default=0.0)))
        return pa.RecordBatch.from_arrays([pa.array(found, pa.float64())], ["k"])

    clean, chance = map_arrow(rows.where("label = 0"), of_best, "k double", rows=200).where("k > 0").agg(F.count("k"), F.sum("k")).first()
    scale = clean / chance if clean else 1.0

    def summaries(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, label = Weights(*spread.value), batch.column("label").to_pylist()
        found = [_summary(held, len(scores), decay, scale) for scores, held in (_left_out(own, text, bool(y)) for text, y in zip(texts_of(batch), label, strict=True))]
        return pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), *(pa.array([f[k] for f in found], pa.float64()) for k in (0, 1))], ["label", "best", "top"])

    seen = map_arrow(rows, summaries, "label int, best double, top double", rows=200).collect()
    drop_materialized(rows)
    return {"counts": weights.counts, "docs": docs_of, "rate": decay, "scale": scale, "curve": _curve([tuple(r) for r in seen], stands_for)}


class Scorer:
    """Scores texts with a model; one for each Python worker."""

    def __init__(self, model: dict):
        self.model = model
        self.weights = None if "share" in model else Weights(model["counts"], model["docs"])

    def __call__(self, texts: list[str], told: bool) -> tuple[np.ndarray, list[list[dict]]]:
        """Probabilities, and the significant passages if asked for."""
        held = self.model
        if self.weights is None:
            return np.full(len(texts), float(held["share"])), [[] for _ in texts]
        best, top, passages = [], [], []
        for text in texts:
            lower = text.lower()
            words = _WORD.findall(lower)
            found = segments(self.weights.scores(words)) if words else []
            b, t = _summary(found, len(words), held["rate"], held["scale"])
            best.append(b)
            top.append(t)
            if told:
                good = [(a, z, s, e) for a, z, s in found if (e := held["scale"] * len(words) * math.exp(-held["rate"] * s)) <= EXPECTED]
                # lower-casing changes the length of a few letters; positions are of the text itself
                spans = [m.span() for m in _WORD.finditer(text if len(lower) == len(text) else lower)] if good else []
                passages.append([{"start": spans[a][0], "end": spans[z - 1][1], "score": s, "expected": e} for a, z, s, e in good])
        f = _shape(np.array(best), np.array(top))
        return 1 / (1 + np.exp(-np.clip(f @ held["curve"][:-1] + held["curve"][-1], -30, 30))), passages


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score, passages array<struct<start, end, score, expected>>.

    Passages are the significant ones; start and end are character positions.
    """
    spread = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])
    own: list[Scorer] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not own:
            own.append(Scorer(spread.value))
        p, passages = own[0](texts_of(batch), True)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(p, pa.float64()), pa.array(passages, pa.list_(passage))], ["doc_id", "score", "passages"]
        )

    schema = "doc_id long, score double, passages array<struct<start:long,end:long,score:double,expected:double>>"
    return map_arrow(docs.select("doc_id", "text"), run, schema, rows=500)


def without_toxic(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all columns, whose score is below the threshold."""
    spread = docs.sparkSession.sparkContext.broadcast(model)
    own: list[Scorer] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not own:
            own.append(Scorer(spread.value))
        return batch.filter(pa.array(own[0](texts_of(batch), False)[0] < threshold))

    return map_arrow(docs, run, docs.schema, rows=500)
