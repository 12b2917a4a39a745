"""Vectorised word hashing over the raw UTF-8 bytes of an Arrow string column.

A word's hash is the sum over its bytes of R[byte] * B**position modulo 2**64, mixed
by a finaliser; a window's hash is the like sum over word hashes.  Everything is a
handful of numpy passes over a whole batch, with no Python loop per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_B = U(0x9E3779B97F4A7C15 | 1)
_W = U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A random 64-bit value for each byte, from a rule.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = U(1)
    return np.multiply.accumulate(out)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null rows are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]] if len(offsets) else raw[:0]
    return raw, offsets - (offsets[0] if len(offsets) else 0)


def word_spans(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words of all rows, and each row's first word (n + 1 entries)."""
    inside = is_word[raw]
    n = len(raw)
    begin = np.zeros(n, bool)
    if n:
        begin[0] = inside[0]
        begin[1:] = inside[1:] & ~inside[:-1]
        edges = offsets[:-1][(offsets[:-1] < n) & (offsets[:-1] < offsets[1:])]
        begin[edges] = inside[edges]
    starts = np.flatnonzero(begin)
    if n:
        stop = np.zeros(n, bool)
        stop[-1] = inside[-1]
        stop[:-1] = inside[:-1] & (~inside[1:] | begin[1:])
        ends = np.flatnonzero(stop) + 1
    else:
        ends = starts
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """A 64-bit hash of each word. `values` maps bytes, so equal values fold bytes (letter case)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    total = int(sizes.sum())
    first = np.cumsum(sizes) - sizes
    place = np.arange(total, dtype=np.int64) - np.repeat(first, sizes)
    at = place + np.repeat(starts, sizes)
    terms = values[raw[at]] * powers(_B, int(sizes.max()))[place]
    return mix(np.add.reduceat(terms, first) + sizes.astype(np.uint64))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of `width` consecutive words (of any row: callers mask row ends)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, p in enumerate(powers(_W, width)):
        out += words[k : k + n] * p
    return mix(out)


def folded_values() -> np.ndarray:
    """BYTE_VALUES with A-Z folded to a-z."""
    out = BYTE_VALUES.copy()
    out[65:91] = out[97:123]
    return out


#: Words of the near-duplicate contract: whatever isn't \x20 or \x09-\x0D.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the rows' `width`-word shingles, sorted within each row, and row offsets.

    A row with fewer words has its whole sequence as one shingle, a row without words none.
    """
    raw, offsets = buffer_of(column)
    starts, ends, first = word_spans(raw, offsets, NON_SPACE)
    words = word_hashes(raw, starts, ends, folded_values())
    counts = np.diff(first)
    hashes = window_hashes(words, width)
    row_of = np.repeat(np.arange(len(counts)), counts)
    # windows that stay inside their row
    whole = np.arange(len(hashes)) + width <= first[1:][row_of[: len(hashes)]] if len(hashes) else np.zeros(0, bool)
    rows, found = row_of[: len(hashes)][whole], hashes[whole]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k, p in enumerate(powers(_W, width)):
            has = counts[short] > k
            extra[has] += words[first[short[has]] + k] * p
        rows = np.concatenate([rows, short])
        found = np.concatenate([found, mix(extra + U(1) + counts[short].astype(np.uint64))])
    order = np.lexsort((found, rows))
    rows, found = rows[order], found[order]
    if len(rows):
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
        rows, found = rows[new], found[new]
    return found, np.searchsorted(rows, np.arange(len(counts) + 1))
