"""Benchmark passages in documents, also with other numbers, names and units.

Texts become templates: numbers, capitalised names inside a sentence and units after a
number turn into typed placeholders, runs of one type into a single one.  Windows of
`WIDTH` template tokens are hashed; a filter of fixed size over the benchmark's windows
drops the documents' other windows on the spot, and the rest are hash-joined.  Windows
that match at one distance between document and item lie on one line.  A line counts if its
slots are consistent: a value of the item always meets the same value of the document.
An item is found if the lines that count cover enough of its windows, or one of them holds
a long run of consecutive ones.

Windows of more slots than words say too little on their own.  An item with fewer than two
others is found where all its windows, these included, lie on one line, or where all its
words and signs stand as they are, letter case aside.  An item of fewer than SHORTEST words
and signs is found in documents that consist of it alone.

Cases: null and empty texts match nothing, and so does an item without words; items of
fewer than WIDTH tokens are one window; repeated rows and ids count once; rows of one item
id with different texts are texts of their own, any of which may be found; rows with null
ids take no part; very long texts are read as a whole; of several lines the one with the
most windows, then the fewest changed values, tells slots and changed; extra columns are
ignored; without documents or items there are no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, filter_of, in_filter, map_arrow, materialize
from .texthash import U, buffer_of, folded_values, mix, window_hashes, word_hashes, word_spans

#: Tokens of a window, and the least words and signs of an item that is searched for inside documents.
WIDTH, SHORTEST = 8, 5
#: An item is found at this share of its windows, or at a run of this many tokens.
COVERAGE, RUN = 0.5, 13
#: Benchmark windows that may be broadcast (about 100 bytes each); beyond, the join is salted.
BROADCAST_ROWS, SALTS = 200_000, 32

#: Units that may follow a number.
UNITS = (
    "mm cm dm m km in ft yd mi miles inch inches foot feet metres meters kilometres kilometers "
    "mg g kg t lb lbs oz grams kilograms ml cl l litres liters gallons "
    "ms s sec secs seconds min mins minutes h hr hrs hour hours day days week weeks month months year years "
    "k c f degrees percent usd eur gbp dollars euros pounds cents mph kmh w kw mw v a hz khz mhz ghz kb mb gb tb "
    "jours heures ans mois tage stunden jahre monate euro horas dias meses"
).split()

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in "+-*/=<>^%"]] = True
_BREAK = ~_WORD
_BREAK[[ord(c) for c in " \t,-'/()"]] = False
_NUMBER, _NAME, _UNIT, _EXACT, _WHOLE = (mix(np.array([k], np.uint64))[0] for k in (101, 102, 103, 104, 105))
#: Ways in which an item is searched for: windows that may stand alone; then, all on one line: all windows, exact ones; the whole document.
_ALONE, _SLOTTED, _STANDING, _ENTIRE = range(4)


def _unit_hashes() -> np.ndarray:
    raw, offsets = buffer_of(pa.array(UNITS))
    starts, ends, _ = word_spans(raw, offsets, _WORD)
    return np.sort(word_hashes(raw, starts, ends, folded_values()))


def templates(column: pa.Array, inside: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template token hashes of all rows, their slot values (0: no slot), each row's first token.

    inside: a row's first word doesn't open a sentence, as where the row is copied into one.
    """
    raw, offsets = buffer_of(column)
    starts, ends, first = word_spans(raw, offsets, _WORD)
    words = word_hashes(raw, starts, ends, folded_values())
    n = len(words)
    if not n:
        return words, words, first
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    head, second = raw[starts], raw[np.minimum(starts + 1, len(raw) - 1)]
    number = (head >= 48) & (head <= 57)
    broken = np.cumsum(_BREAK[raw])
    opening = np.ones(n, bool)
    opening[1:] = (row[1:] != row[:-1]) | (broken[starts[1:] - 1] > broken[ends[:-1] - 1])
    if inside:
        opening[first[:-1][first[:-1] < first[1:]]] = False
    name = (head >= 65) & (head <= 90) & (ends - starts > 1) & (((second >= 97) & (second <= 122)) | (second >= 128)) & ~opening
    unit = np.zeros(n, bool)
    after = np.flatnonzero(number[:-1] & (row[1:] == row[:-1])) + 1
    known = _unit_hashes()
    unit[after] = known[np.minimum(np.searchsorted(known, words[after]), len(known) - 1)] == words[after]
    kind = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, U(0))))
    slot = kind != 0
    new = np.ones(n, bool)
    new[1:] = ~(slot[1:] & (kind[1:] == kind[:-1]) & (row[1:] == row[:-1]))
    at = np.flatnonzero(new)
    values = np.where(slot[at], mix(np.add.reduceat(words, at) | U(1)) | U(1), U(0))
    tokens = np.where(slot[at], kind[at], words[at])
    return tokens, values, np.searchsorted(at, first)


def _cut(tokens: np.ndarray, values: np.ndarray, first: np.ndarray, widths: list[int], whole: bool, least_words: float) -> tuple[np.ndarray, ...]:
    """Windows that lie in one row, a share of them words at least: hash, row, position, width, all slot values.

    whole: a row with fewer than WIDTH tokens gives one window of its own size instead.
    """
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    found = []
    for width in widths:
        h = window_hashes(tokens, width)
        if not len(h):
            continue
        words = np.convolve((values == 0).astype(np.int32), np.ones(width, np.int32), "valid")
        ok = (np.arange(len(h)) + width <= first[1:][row[: len(h)]]) & (words >= least_words * width)
        if whole and width < WIDTH:
            ok &= counts[row[: len(h)]] == width
        at = np.flatnonzero(ok)
        found.append((mix(h[at] + U(width)), row[at], at - first[row[at]], np.full(len(at), width), at))
    if not found:
        z = np.zeros(0, np.int64)
        return z.view(np.uint64), z, z, z, (values, z)
    h, r, p, w, at = (np.concatenate(x) for x in zip(*found, strict=True))
    return h, r, p, w, (values, at)


def _windows(column: pa.Array, widths: list[int], whole: bool, inside: bool = False, least_words: float = 0.5) -> tuple[np.ndarray, ...]:
    """Windows of templates."""
    return _cut(*templates(column, inside), widths, whole, least_words)


def _exact_tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like templates, of case-folded words and signs as they stand: there are no slots."""
    raw, offsets = buffer_of(column)
    spans = [word_spans(raw, offsets, kind)[:2] for kind in (_WORD, _SIGN)]
    starts, ends = (np.concatenate(x) for x in zip(*spans, strict=True))
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    tokens = word_hashes(raw, starts, ends, folded_values())
    return tokens, np.zeros(len(tokens), np.uint64), np.searchsorted(starts, offsets)


def _exact_windows(column: pa.Array, widths: list[int], whole: bool) -> tuple[np.ndarray, ...]:
    h, *rest = _cut(*_exact_tokens(column), widths, whole, 0)
    return mix(h ^ _EXACT), *rest


def _entire(column: pa.Array) -> list[tuple[np.ndarray, ...]]:
    """Rows of fewer than SHORTEST words and signs as one window each: as they stand, and as templates of two words at least."""
    tokens, none, first = _exact_tokens(column)
    counts = np.diff(first)
    out = []
    for k, (own, values, begin) in enumerate(((tokens, none, first), templates(column))):
        size, told = np.diff(begin), np.concatenate([[0], np.cumsum(values == 0)])
        held = []
        for width in range(1, SHORTEST):
            row = np.flatnonzero((size == width) & (counts < SHORTEST))
            if k:
                row = row[told[begin[row] + width] - told[begin[row]] >= 2]
            h = window_hashes(own, width)[begin[row]] if len(row) else np.zeros(0, np.uint64)
            held.append((mix((h + U(width + 64 * k)) ^ _WHOLE), row, np.zeros(len(row), np.int64), np.full(len(row), width), begin[row]))
        h, r, p, w, at = (np.concatenate(x) for x in zip(*held, strict=True))
        out.append((h, r, p, w, (values, at)))
    return out


def _slots(held: tuple, pick: np.ndarray, widths: np.ndarray) -> list:
    """Slot values of the picked windows, None where a window has none."""
    values, at = held
    out = []
    for k, w in zip(at[pick].tolist(), widths[pick].tolist(), strict=True):
        part = values[k : k + w]
        out.append(part.view(np.int64).tolist() if part.any() else None)
    return out


def _batch(ids: pa.Array, id_name: str, found: tuple, pick: np.ndarray, form: int = 0, said: np.ndarray | None = None) -> pa.RecordBatch:
    """form: the way in which the item is searched for; said: of each row of ids, what tells its texts apart."""
    h, row, place, width, held = found
    slots = _slots(held, pick, width) if len(pick) else []
    own = [pa.array(h[pick].view(np.int64)), ids.take(pa.array(row[pick])), pa.array(place[pick].astype(np.int32)), pa.array(slots, pa.list_(pa.int64()))]
    names = ["w", id_name, "place", "slots"]
    if said is not None:
        own += [pa.array(width[pick].astype(np.int32)), pa.array(np.full(len(pick), form, np.int32)), pa.array(said[row[pick]])]
        names += ["width", "form", "said"]
    return pa.RecordBatch.from_arrays(own, names)


def hash_of(text: str | None) -> int:
    """A number of a text."""
    return int.from_bytes(hashlib.blake2b((text or "").encode(), digest_size=7).digest())


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches(max_chunksize=None)[0] if sum(p.num_rows for p in parts) else parts[0]


def _longest_run(places: Column) -> Column:
    """The most consecutive numbers in an ascending array."""
    step = lambda a, p: F.struct(
        p.alias("last"), F.when(p == a["last"] + 1, a["now"] + 1).otherwise(1).alias("now"), F.greatest(a["best"], F.when(p == a["last"] + 1, a["now"] + 1).otherwise(1)).alias("best")
    )
    start = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("now"), F.lit(0).alias("best"))
    return F.aggregate(places, start, step, lambda a: a["best"])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> one row per document and item found in it.

    doc_id, item_id, matched (windows of the item found), windows (of the item), coverage,
    slots (distinct values compared), changed (of those, with another value).
    """
    spark = docs.sparkSession
    sizes = list(range(SHORTEST, WIDTH + 1))

    def of_items(batch: pa.RecordBatch) -> pa.RecordBatch:
        text, ids = batch.column("text"), batch.column("item_id").cast(pa.int64())
        said = np.array([hash_of(t) for t in text.to_pylist()], np.int64)
        found, other = _windows(text, sizes, True), _windows(text, sizes, True, inside=True)
        few = np.bincount(found[1], minlength=batch.num_rows) < 2
        # where the item stands inside a sentence, its first word may read as a name
        also = lambda a, b: np.flatnonzero((b[2] == 0) & ~np.isin(b[0], a[0]))
        parts = [_batch(ids, "item_id", found, np.arange(len(found[0])), _ALONE, said), _batch(ids, "item_id", other, also(found, other), _ALONE, said)]
        slotted, beside = _windows(text, sizes, True, least_words=0), _windows(text, sizes, True, inside=True, least_words=0)
        rows = np.arange(batch.num_rows)
        told = np.bincount(rows.repeat(np.diff(templates(text)[2])), weights=templates(text)[1] == 0, minlength=batch.num_rows) >= 2
        parts += [_batch(ids, "item_id", f, p[(few & told)[f[1][p]]], _SLOTTED, said) for f, p in ((slotted, np.arange(len(slotted[0]))), (beside, also(slotted, beside)))]
        exact = _exact_windows(text, sizes, True)
        parts.append(_batch(ids, "item_id", exact, np.flatnonzero(few[exact[1]]), _STANDING, said))
        parts += [_batch(ids, "item_id", f, np.arange(len(f[0])), _ENTIRE, said) for f in _entire(text)]
        return _joined(parts)

    items = benchmark.where("item_id is not null").select("item_id", "text").dropDuplicates(["item_id", "text"])
    items = materialize(map_arrow(items, of_items, "w long, item_id long, place int, slots array<long>, width int, form int, said long", rows=500), "windows")
    used = {form: set() for form in range(4)}  # widths in use by form
    for r in items.select("width", "form").distinct().collect():
        used[r.form].add(r.width)
    spread = spark.sparkContext.broadcast((filter_of(items.select("w")), used))

    def of_docs(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits, widths = spread.value
        text, ids = batch.column("text"), batch.column("doc_id").cast(pa.int64())
        # windows of few words only where an item asks for them
        made = [_windows(text, sorted(widths[_ALONE] | widths[_SLOTTED]), False, least_words=0 if widths[_SLOTTED] else 0.5)]
        if widths[_STANDING]:
            made.append(_exact_windows(text, sorted(widths[_STANDING]), False))
        if widths[_ENTIRE]:
            made += _entire(text)
        return _joined([_batch(ids, "doc_id", found, np.flatnonzero(in_filter(bits, found[0]))) for found in made])

    seen = map_arrow(docs.where("doc_id is not null").select("doc_id", "text"), of_docs, "w long, doc_id long, place int, slots array<long>", rows=500)
    seen = seen.withColumnsRenamed({"slots": "doc_slots", "place": "doc_place"})
    if items.count() <= BROADCAST_ROWS:
        hits = seen.join(F.broadcast(items), "w")
    else:  # a window that very many documents share is spread over SALTS tasks
        salted = items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = seen.withColumn("salt", F.pmod(F.xxhash64("doc_id", "doc_place"), F.lit(SALTS)).cast("int")).join(salted, ["w", "salt"])
    pair, line = ["doc_id", "item_id", "said", "form"], (F.col("doc_place") - F.col("place")).alias("line")
    found = materialize(hits.select(*pair, line, "place", "width", "slots", "doc_slots"), "hits")
    needed = items.groupBy("item_id", "said", "form").agg(F.countDistinct("place").alias("windows"), F.max("width").alias("width"))
    values = (
        found.where("slots is not null and doc_slots is not null")
        .select(*pair, "line", F.explode(F.arrays_zip("slots", "doc_slots")).alias("z"))
        .where("z.slots <> 0")
        .groupBy(*pair, "line", F.col("z.slots").alias("own"))
        .agg(F.min("z.doc_slots").alias("least"), F.max("z.doc_slots").alias("most"))
        .groupBy(*pair, "line")
        .agg(F.count(F.lit(1)).alias("slots"), F.sum((F.col("least") != F.col("most")).cast("long")).alias("torn"), F.sum((F.col("least") != F.col("own")).cast("long")).alias("changed"))
    )
    lines = found.groupBy(*pair, "line").agg(F.sort_array(F.collect_set("place")).alias("places"))  # an item's windows at most
    lines = lines.join(values, [*pair, "line"], "left").where("slots is null or torn * 4 <= slots")
    lines = lines.fillna(0, ["slots", "changed"]).withColumn("run", _longest_run(F.col("places")))
    covered = lines.select(*pair, F.explode("places").alias("place")).distinct().groupBy(*pair).agg(F.count(F.lit(1)).alias("matched"))
    best = lines.groupBy(*pair).agg(F.max("run").alias("run"), F.max(F.size("places")).alias("longest"), F.max(F.struct(F.size("places"), -F.col("changed"), "slots")).alias("main"))
    told = covered.join(best, pair).join(needed, ["item_id", "said", "form"])
    enough = (F.col("matched") >= COVERAGE * F.col("windows")) | (F.col("run") + F.col("width") - 1 >= RUN)
    told = told.where(F.when(F.col("form") == _ALONE, enough).otherwise(F.col("longest") == F.col("windows")))
    share = F.round(F.col("matched") / F.col("windows"), 6)
    # the way that covers most speaks for the pair
    one = told.groupBy("doc_id", "item_id").agg(F.max(F.struct(share.alias("coverage"), "matched", "windows", F.col("main.slots").alias("slots"), (-F.col("main.col2")).alias("changed"))).alias("m"))
    result = materialize(one.select("doc_id", "item_id", "m.matched", "m.windows", "m.coverage", "m.slots", "m.changed"), "leaks")
    drop_materialized(items)
    drop_materialized(found)
    return result
