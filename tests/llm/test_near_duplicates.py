"""MinHash near-duplicates against brute force, and connected components."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import minhash
from tessera.llm.common import filter_of, in_filter
from tessera.llm.components import components
from tessera.llm.texthash import shingle_sets

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def classes(rows, width, percent):
    """doc_id -> (set size, least reachable id), by comparing everything with everything."""
    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}, sets


def variant(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    out = []
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(30, 150))]
        out += [variant(rng, base, e) for e in (0, 0, 1, 2, 3, 5, 9, 14)]
    hot = [word() for _ in range(120)]
    out += [variant(rng, hot, rng.randrange(0, 7)) for _ in range(150)]
    out += [" ".join(passage + [word() for _ in range(rng.randrange(5, 40))]) for _ in range(60)]
    out += ["", None, " \t\n", "one", "ONE", "one two", "É é", "é é", "a b c", "a\x0bb\x0cc", "x" * 70_000, "word " * 3000]
    rng.shuffle(out)
    return [*enumerate(out), (3, "once more three"), (None, out[0]), (400, out[7]), (400, out[7])]


@pytest.mark.parametrize(("width", "block"), [(4, 2000), (5, 20)])
def test_against_brute_force(spark, rows, width, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    df = spark.createDataFrame([(i, t, "k", 1, "l") for i, t in rows], "doc_id long, text string, key string, n int, label string")
    expected, sets = classes(rows, width, 80)
    found = minhash.near_duplicates(df.repartition(5), width=width).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.component_id, r.kept) == (expected[r.doc_id], expected[r.doc_id] == r.doc_id)
    assert sorted((r.doc_id, r.n_shingles) for r in found if r.doc_id is not None) == sorted((i, len(s)) for i, s in sets)


def test_cells_hold_two_blocks(spark, monkeypatch):
    """A passage in very many documents: every pair of rows of different components meets in a cell, and no cell grows."""
    monkeypatch.setattr(minhash, "BLOCK", 20)
    members = spark.range(400).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("doc_id"))
    labels = spark.range(1, 150).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("label"))
    cells = {}
    for r in minhash._cells(members, labels).collect():
        cells.setdefault(r.cell, []).append((r.doc_id, r.label, r.minor))
    assert max(len(c) for c in cells.values()) < 3 * 2 * 20
    met = {(min(a[0], b[0]), max(a[0], b[0])) for c, held in cells.items() for a in held for b in held if a[1] != b[1] and (c < 0 or a[2] != b[2])}
    assert len(met) == 250 * 150 + 250 * 249 // 2


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shingles_of_slices():
    texts = ["a b c d e", None, "", "A b", "é\tü ö\nß x", "q " * 500]
    column = pa.array(["skip", *texts]).slice(1)
    found, offsets = shingle_sets(column, 3)
    assert np.diff(offsets).tolist() == [len(shingles(t, 3)) for t in texts]
    same, _ = shingle_sets(pa.array(["a b", "A B"]), 3)
    assert same[0] == same[1]
    assert (np.diff(found[offsets[0] : offsets[1]].astype(object)) > 0).all()


@pytest.mark.parametrize("hot", [256, 5])
def test_components_against_union_find(spark, monkeypatch, hot):
    from tessera.llm import components as module

    monkeypatch.setattr(module, "HOT", hot)
    rng = random.Random(2)
    edges = [(rng.randrange(-50, 300), rng.randrange(-50, 300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, 5000 + k) for k in range(200)] + [(9000, 8000 + k) for k in range(150)] + [(8007, 5003)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "u long, v long")
    assert {r.node: r.component for r in components(df).collect()} == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(df.limit(0)).count() == 0


def test_filter_never_loses(spark):
    bits = filter_of(spark.range(2000).selectExpr("xxhash64(id) h"))
    held = np.array([r.h for r in spark.range(2000).selectExpr("xxhash64(id) h").collect()])
    other = np.array([r.h for r in spark.range(5000, 8000).selectExpr("xxhash64(id) h").collect()])
    assert in_filter(bits, held).all() and in_filter(bits, other).mean() < 0.01
