"""Secrets in texts: fixed patterns, and other tokens by a randomness test battery.

The patterns give the base spans.  Any other token of TOKEN characters gets an inferred
encoding (the smallest alphabet that holds it) and three tests against uniform draws
from it: chi-squared of the symbol counts, runs about the middle of the alphabet and
serial correlation, combined by Fisher's method.  That a token passes says that it may be
random, not that ordinary text couldn't pass as well.  So a token that passes is tested the other
way round too: for each of the three properties (how often symbols occur, runs of one
character class, which symbol follows which) its likelihood as uniform draws is held
against that of ordinary text of the corpus in the same alphabet.  Together they bound the
probability that an ordinary token looks as random; that is controlled for false
discoveries over the whole corpus, apart for each class of lengths, since long tokens say
more than short ones.

Cases: null text is empty and has no span; documents without candidates keep their row;
repeated rows each get a row, and each counts in the control of discoveries; candidates of
equal likelihood stand or fall together; very long texts are scanned once, in linear time;
extra columns are ignored; positions are code points; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, map_arrow, materialize, texts_of
from .texthash import buffer_of, word_spans

#: The base patterns, letters of the first in either case, with the least length of group or match.
PATTERNS = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE, 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 0, 18),
    ("hex", r"[0-9a-f]+", 0, 0, 16),
)
KINDS = tuple(p[0] for p in PATTERNS) + ("random",)
_COMPILED = [(kind, re.compile(p, flags | re.ASCII), group, least) for kind, p, flags, group, least in PATTERNS]
#: The same matches where short ones can't hold a match that counts: a run either is long enough or fails as a whole.
_RUNS = {"hex": re.compile(r"[0-9a-f]{16,}")}

#: Least characters of a token that is tested: at 12 a fifth of uniform tokens can't be told from ordinary text, at 16 a twentieth.
TOKEN = 16
#: Characters from which a token isn't counted as ordinary text; shorter ones are words too often.
LEFT_OUT = 20
_TOKEN = re.compile(rf"[A-Za-z0-9+/_-]{{{TOKEN},}}={{0,2}}")
#: Alphabets by size: the first that holds a token is its encoding.
ALPHABETS = (
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("lower", "abcdefghijklmnopqrstuvwxyz"),
    ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("mixed", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
_SETS = [(name, frozenset(a), {c: i for i, c in enumerate(a)}) for name, a in ALPHABETS]
#: Rate at which ordinary tokens change class, at most; random enough; false discovery rate.
CHANGE, RANDOM, RATE = 0.2, 0.001, 0.01
#: Class moves of ordinary text from small letters, capitals and digits to each of them.
_MOVES = ((1 - CHANGE, CHANGE / 2, CHANGE / 2), ((1 - CHANGE) / 2, (1 - CHANGE) / 2, CHANGE), (CHANGE / 2, CHANGE / 2, 1 - CHANGE))
#: Usual percentages of the letters a to z in European languages, which count as 1000 letters; share of uniform letters in any text.
USUAL = (8.5, 1.4, 3.5, 4.2, 14, 1.6, 1.8, 3.5, 7.2, 0.4, 0.7, 4.6, 2.7, 7.8, 6.2, 2.2, 0.6, 6.6, 7, 7.2, 4.2, 1.2, 1.1, 0.25, 1, 0.6)
UNSEEN = 0.05
#: Bytes of tested tokens; bytes to letters, 26 for none.
_HELD = np.zeros(256, bool)
_HELD[[ord(c) for c in ALPHABETS[-1][1]]] = True
_LETTER = np.full(256, 26, np.uint8)
_LETTER[65:91] = _LETTER[97:123] = np.arange(26)
#: Starts of the length classes, and steps of log10 p per unit in the counts of probabilities.
LENGTHS, STEPS, DEEPEST = (TOKEN, 20, 28, 40, 64), 20, 30


def _normal_tail(z: float) -> float:
    """Two-sided tail of the normal distribution."""
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_tail(x: float, df: int) -> float:
    """Upper tail of chi-squared, by the cube-root approximation."""
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: str) -> tuple[str, float]:
    """Inferred encoding, and the combined probability of uniform draws from it."""
    body = token.rstrip("=")
    have = set(body)
    name, order = next(((n, o) for n, s, o in _SETS if have <= s), ("other", None))
    if order is None or len(body) < 8:
        return name, 0.0
    codes, size, n = [order[c] for c in body], len(order), len(body)
    # chi-squared over cells that are expected to hold some three symbols each
    cells = max(2, min(size, n // 3))
    counts = [0] * cells
    for c in codes:
        counts[c * cells // size] += 1
    share = [0.0] * cells
    for c in range(size):
        share[c * cells // size] += n / size
    p_chi = _chi_tail(sum((a - e) ** 2 / e for a, e in zip(counts, share, strict=True)), cells - 1)
    up = [c >= size / 2 for c in codes]
    a = sum(up)
    b = n - a
    if a and b:
        runs = 1 + sum(x != y for x, y in zip(up, up[1:], strict=False))
        mean = 1 + 2 * a * b / n
        spread = math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
        p_runs = _normal_tail((runs - mean) / spread)
    else:
        p_runs = 2.0 ** (1 - n)
    middle = sum(codes) / n
    square = sum((c - middle) ** 2 for c in codes)
    p_serial = 0.0
    if square:
        r = sum((x - middle) * (y - middle) for x, y in zip(codes, codes[1:], strict=False)) / square
        p_serial = _normal_tail((r + 1 / n) * math.sqrt(n))
    half = -math.log(max(p_chi, 1e-300)) - math.log(max(p_runs, 1e-300)) - math.log(max(p_serial, 1e-300))
    # Fisher: chi-squared with 6 degrees of freedom at twice the sum
    return name, math.exp(-half) * (1 + half + half * half / 2)


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def letter_pairs(docs: DataFrame) -> np.ndarray:
    """How often each letter (folded; 26 stands for none) follows each, over all texts, tokens of LEFT_OUT characters left out."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets = buffer_of(batch.column("text"))
        codes = _LETTER[raw]
        starts, ends, _ = word_spans(raw, offsets, _HELD)
        for k in np.flatnonzero(ends - starts >= LEFT_OUT).tolist():
            codes[starts[k] : ends[k]] = 26
        before = np.concatenate([[26], codes[:-1]]).astype(np.int64) if len(codes) else np.zeros(0, np.int64)
        before[offsets[:-1][offsets[:-1] < len(codes)]] = 26
        n = np.bincount(before * 27 + codes, minlength=729)
        at = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], ["pair", "n"])

    out = np.zeros(729)
    for r in map_arrow(docs.select("text"), run, "pair int, n long", rows=1000).groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r.pair] = r.n
    return out.reshape(27, 27)


class Evidence:
    """Likelihood of a token as uniform draws from its encoding, against ordinary text in the same alphabet.

    Ordinary text changes its character class at a rate of CHANGE, a capital before a
    small letter and the borders of joined parts being no change, and its letters occur and
    follow each other as in the corpus.  Digits and joining characters tell nothing.  For
    ordinary tokens of a length the ratio is 1 on average, so by Markov's inequality its
    inverse bounds their tail probability; the choice of encoding counts as so many tests.
    """

    def __init__(self, pairs: np.ndarray):
        usual = np.array(USUAL) / sum(USUAL)
        single = (pairs[:, :26].sum(axis=0) + 1000 * usual) / (pairs[:, :26].sum() + 1000)
        follow = (pairs[:, :26] + 50 * single) / (pairs[:, :26].sum(axis=1, keepdims=True) + 50)
        self.single = (1 - UNSEEN) * single + UNSEEN / 26
        self.letters = (1 - UNSEEN) * follow + UNSEEN / 26
        self.tables: dict[str, dict[str, dict[str, tuple[float, float, float]]]] = {}

    def _table(self, alphabet: str) -> dict[str, dict[str, tuple[float, float, float]]]:
        """Log ratios of each symbol behind each other: of its frequency, of the class's run, of the order."""
        kinds = [_class(c) for c in alphabet]
        own = np.bincount(kinds, minlength=4) / len(alphabet)
        letters = {k: [ord(c.lower()) - 97 for c, x in zip(alphabet, kinds, strict=True) if x == k] for k in (0, 1)}
        out = {}
        for x, kind in zip(alphabet, kinds, strict=True):
            if kind == 3:
                move = own
            else:
                move = np.array([*_MOVES[kind], 0.0]) * (own > 0)
                move = move / move.sum() * (1 - own[3])
                move[3] = own[3]
            follow = self.letters[ord(x.lower()) - 97 if kind < 2 else 26]
            row = {}
            for c, k in zip(alphabet, kinds, strict=True):
                even = 1 / (own[k] * len(alphabet))
                alone = behind = even
                if k < 2:
                    at = ord(c.lower()) - 97
                    alone, behind = self.single[at] / self.single[letters[k]].sum(), follow[at] / follow[letters[k]].sum()
                row[c] = (-math.log(alone / even), -math.log(move[k] / own[k]), -math.log(behind / alone))
            out[x] = row
        return out

    def tests(self, encoding: str, body: str) -> tuple[float, float, float]:
        """Natural log ratios of uniformity, runs and serial order."""
        table = self.tables.get(encoding)
        if table is None:
            table = self.tables[encoding] = self._table(dict(ALPHABETS)[encoding])
        return tuple(map(sum, zip(*(table[x][c] for x, c in zip(body, body[1:], strict=False)), strict=True)))

    def depth(self, encoding: str, body: str) -> float:
        """-log10 of the probability that ordinary text looks as much like uniform draws, by all three."""
        return min(DEEPEST, max(0.0, sum(self.tests(encoding, body)) / math.log(10) - math.log10(len(ALPHABETS))))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns' matches, leftmost and not overlapping per kind."""
    out = []
    for kind, pattern, group, least in _COMPILED:
        for m in _RUNS.get(kind, pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _merged(spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Spans in order of their starts as disjoint stretches."""
    out: list[tuple[int, int]] = []
    for a, z, _ in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def candidates(text: str, base: list[tuple[int, int, str]], evidence: Evidence) -> list[dict]:
    """Tokens outside the base spans, with -log10 of their ordinary probability where they pass as random."""
    out, at, taken = [], 0, _merged(base)
    for m in _TOKEN.finditer(text):
        a, z = m.span()
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if at < len(taken) and taken[at][0] < z:
            continue
        encoding, q = battery(m.group())
        depth = evidence.depth(encoding, m.group().rstrip("=")) if q >= RANDOM else 0.0
        out.append({"start": a, "end": z, "encoding": encoding, "depth": depth})
    return out


def _length_class(size: F.Column) -> F.Column:
    found = F.lit(0)
    for k, start in enumerate(LENGTHS):
        found = F.when(size >= start, F.lit(k)).otherwise(found)
    return found


def _thresholds(found: DataFrame) -> list[float]:
    """Per length class, the depth (-log10 p) from which tokens are discoveries (Benjamini and Hochberg).

    Counts by class and by step of depth reach the driver: a table of fixed size.
    """
    c = F.explode("candidates").alias("c")
    counts = (
        found.select(c)
        .groupBy(_length_class(F.col("c.end") - F.col("c.start")).alias("k"), F.floor(F.col("c.depth") * STEPS).cast("int").alias("step"))
        .count()
        .collect()
    )
    out = []
    for k in range(len(LENGTHS)):
        own = sorted(((r.step, r["count"]) for r in counts if r.k == k), reverse=True)
        total, seen, limit = sum(n for _, n in own), 0, math.inf
        for step, n in own:
            seen += n
            if step > 0 and 10 ** (-step / STEPS) <= RATE * seen / total:
                limit = step / STEPS
        out.append(limit)
    return out


def _scanned(docs: DataFrame, pairs: np.ndarray) -> DataFrame:
    """doc_id, base spans, tested candidates and the base spans' digest of each document, materialized."""
    span = "array<struct<start:long,end:long,kind:string>>"
    own: list[Evidence] = []  # one for each Python worker

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, more, digest = [], [], []
        if not own:
            own.append(Evidence(pairs))
        evidence = own[0]
        for text in texts_of(batch):
            spans = base_spans(text)
            base.append([{"start": a, "end": z, "kind": k} for a, z, k in spans])
            more.append(candidates(text, spans, evidence))
            digest.append(hashlib.sha256(",".join(f"{k}:{a}:{z}" for a, z, k in spans).encode()).hexdigest())
        held = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        tested = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("depth", pa.float64())]))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(base, held), pa.array(more, tested), pa.array(digest)], ["doc_id", "base", "candidates", "base_sha256"]
        )

    schema = f"doc_id long, base {span}, candidates array<struct<start:long,end:long,encoding:string,depth:double>>, base_sha256 string"
    return materialize(map_arrow(docs.select("doc_id", "text"), run, schema, rows=1000), "spans")


def find_secrets(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, base array, found array (both struct<start, end, kind>), base_sha256.

    found holds the base spans and the random tokens, by start.
    """
    found = _scanned(docs, letter_pairs(docs))
    limits = F.array(*[F.lit(x) for x in _thresholds(found)])
    random = F.transform(
        F.filter("candidates", lambda c: c.depth >= F.get(limits, _length_class(c.end - c.start))),
        lambda c: F.struct(c.start.alias("start"), c.end.alias("end"), F.lit("random").alias("kind")),
    )
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s.kind)
    keyed = F.transform(F.concat("base", random), lambda s: F.struct(s.start.alias("start"), rank(s).alias("r"), s.end.alias("end"), s.kind.alias("kind")))
    ordered = F.transform(F.array_sort(keyed), lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind")))
    result = materialize(found.select("doc_id", "base", ordered.alias("found"), "base_sha256"), "secrets")
    drop_materialized(found)
    return result


def covered(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, and each run of overlapping ones, replaced by `[kind]`."""
    out, at = [], 0
    for a, z, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, z)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all columns: secrets are replaced in text, and n_chars follows where it is there.

    The letters' pairs and the thresholds come from a pass each over all documents; the third pass replaces in
    place, so that no text is shuffled.  Texts without secrets stay as they are.
    """
    pairs = letter_pairs(docs)
    scanned = _scanned(docs, pairs)
    limits = _thresholds(scanned)
    drop_materialized(scanned)
    own: list[Evidence] = []  # one for each Python worker

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        if not own:
            own.append(Evidence(pairs))
        evidence = own[0]
        for k, text in enumerate(texts):
            if text:
                spans = base_spans(text)
                for c in candidates(text, spans, evidence):
                    size = c["end"] - c["start"]
                    if c["depth"] >= limits[max(i for i, s in enumerate(LENGTHS) if size >= s)]:
                        spans.append((c["start"], c["end"], "random"))
                if spans:
                    texts[k] = covered(text, spans)
        place = batch.schema.get_field_index("text")
        out = batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))
        if (n := batch.schema.get_field_index("n_chars")) >= 0:
            sizes = [old if text is None else len(text) for text, old in zip(texts, batch.column("n_chars").to_pylist(), strict=True)]
            out = out.set_column(n, batch.schema.field(n), pa.array(sizes, batch.schema.field(n).type))
        return out

    return map_arrow(docs, run, docs.schema, rows=1000)
