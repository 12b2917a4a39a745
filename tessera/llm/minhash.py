"""Near-duplicate documents: MinHash, banding, verification, star-based components.

1. One pass over the texts gives each document's shingle set as a size, a 128-bit
   fingerprint, `bands` band keys of `rows` minima each, and the low byte of every
   minimum (the signature used to verify candidates).
2. Equal fingerprints are equal sets: one representative goes on for each.
3. Band keys that several representatives share are buckets.  Each member is first
   confirmed against the least member that any of its buckets holds; that joins the
   large groups of near copies with one comparison a document.
4. Buckets that still hold several components are searched across components.  Both the
   largest component's rows and the others are dealt in blocks, and each pair of blocks is
   a cell, so neither a huge group nor a passage shared by many documents meets in one
   task.  Cells compare signatures alone first; only rows with a possible partner get
   their sets and are compared on them, and of the links between two components one
   leaves a cell.  Links that leave are confirmed on the full texts.
5. Components by large-star and small-star over confirmed links.

Words and shingles are compared as 64-bit hashes, sets as 128-bit sums with their sizes, so
that different ones are taken for equal with a probability of about 2**-64 a pair of words.

Cases: null or word-less texts have the empty set, link with nothing and are kept; very
long texts are read as a whole; texts under `width` words are one shingle; rows of the same doc_id are one node (its
texts' links add up); rows with null doc_id are returned unlinked (component_id null,
kept false); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, filter_of, in_filter, map_arrow, materialize
from .components import nodes_of, stars
from .texthash import U, mix, shingle_sets

#: Rows of a bucket that are compared as one block; a cell holds two blocks.
BLOCK = 1000


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n odd multipliers and addends of the universal hash family, from a rule."""
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * U(0xA0761D6478BD642F))
    return x[:n] | U(1), x[n:]


def minima(hashes: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n minima of each non-empty row's set, as 32-bit values (rows x n)."""
    sizes = np.diff(offsets)
    full = np.flatnonzero(sizes)
    out = np.zeros((len(full), n), np.uint32)
    a, b = _coefficients(n)
    # rows are grouped so that the working arrays stay in cache
    at = 0
    while at < len(full):
        lo = offsets[full[at]]
        to = max(at + 1, int(np.searchsorted(offsets[full + 1], lo + 60_000, "right")))
        part = hashes[lo : offsets[full[to - 1] + 1]]
        cuts = offsets[full[at:to]] - lo
        work = np.empty_like(part)
        for k in range(n):
            np.multiply(part, a[k], out=work)
            np.add(work, b[k], out=work)
            out[at:to, k] = np.minimum.reduceat(work, cuts) >> U(32)
        at = to
    return out


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, hash, n, fp1, fp2, keys array<long>, sig binary) for each row of docs (doc_id, text).

    hash is that of the text, so that doc_id and hash name a text even where ids repeat.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, offsets = shingle_sets(batch.column("text"), width)
        sizes = np.diff(offsets)
        full = np.flatnonzero(sizes)
        fp1, fp2 = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
        if len(full):
            fp1[full] = np.add.reduceat(hashes, offsets[full])
            fp2[full] = np.add.reduceat(mix(hashes ^ U(0x1234567)), offsets[full])
        least = minima(hashes, offsets, bands * rows)
        keys = np.zeros((len(full), bands), np.uint64)
        for k in range(bands):
            key = np.full(len(full), U(k + 1))
            for r in range(rows):
                key = mix(key * U(0x9E3779B97F4A7C15) + least[:, k * rows + r])
            keys[:, k] = key
        low = (least & 255).astype(np.uint8)
        where = np.full(len(sizes), -1)
        where[full] = np.arange(len(full))
        listed = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]), pa.int32()), pa.array(keys.ravel().view(np.int64))
        )
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()),
                batch.column("hash"),
                pa.array(sizes.astype(np.int64)),
                pa.array(fp1.view(np.int64)),
                pa.array(fp2.view(np.int64)),
                listed,
                pa.array([low[w].tobytes() if w >= 0 else None for w in where], pa.binary()),
            ],
            ["doc_id", "hash", "n", "fp1", "fp2", "keys", "sig"],
        )

    schema = "doc_id long, hash long, n long, fp1 long, fp2 long, keys array<long>, sig binary"
    return map_arrow(docs.select("doc_id", "text", F.xxhash64("text").alias("hash")), run, schema, rows=500)


def _class_ids(classes: DataFrame) -> DataFrame:
    """A 64-bit id for each class; another seed should two classes ever share one."""
    for seed in range(100):
        named = classes.withColumn("cid", F.xxhash64(F.lit(seed), "fp1", "fp2", "n"))
        if named.groupBy("cid").count().where("count > 1").isEmpty():
            return named
    raise RuntimeError("no seed tells the classes apart")


def _only_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of df whose doc_id is probably among ids (column doc_id); never loses one.

    A filter of a fixed 8 MB is sent to the tasks, so that the texts of documents
    without any candidate are never shuffled.
    """
    hashed = F.xxhash64("doc_id")
    spread = df.sparkSession.sparkContext.broadcast(filter_of(ids.select(hashed.alias("h"))))

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(in_filter(spread.value, h.to_numpy(np.int64)))

    return df.where(F.col("doc_id").isNotNull()).where(maybe(hashed))


def _alike(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Estimated similarity of signatures of low bytes, row by row."""
    same = (left == right).mean(axis=-1)
    return (same - 1 / 256) / (1 - 1 / 256)


def _floor(similarity: float, hashes: int) -> float:
    """The least estimate that a link can plausibly have: four standard deviations below."""
    return similarity - 4 * (similarity * (1 - similarity) / hashes) ** 0.5


def _by_signature(pairs: DataFrame, sigs: DataFrame, least: float, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures allow a link."""
    held = sigs.select("doc_id", "n", "sig")
    wide = pairs.join(held.toDF("a", "na", "sa"), "a").join(held.toDF("b", "nb", "sb"), "b").where(
        F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb")]
        keep = pa.array(_alike(*both) >= least) if batch.num_rows else pa.array([], pa.bool_())
        return batch.select(["a", "b"]).filter(keep)

    return map_arrow(wide.select("a", "b", "sa", "sb"), run, "a long, b long", rows=5000)


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    wide = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        (ha, oa), (hb, ob) = (shingle_sets(batch.column(c), width) for c in ("ta", "tb"))
        na, nb = np.diff(oa), np.diff(ob)
        rows = np.concatenate([np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)])
        found = np.concatenate([ha, hb])
        order = np.lexsort((found, rows))
        rows, found = rows[order], found[order]
        shared = np.flatnonzero((rows[1:] == rows[:-1]) & (found[1:] == found[:-1]))
        both = np.bincount(rows[shared], minlength=len(na)) if len(shared) else np.zeros(len(na), int)
        linked = (na > 0) & (100 * both >= percent * (na + nb - both))
        return batch.select(["a", "b"]).filter(pa.array(linked))

    return map_arrow(wide.select("a", "b", "ta", "tb"), run, "a long, b long", rows=300)


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(doc_id, words): each text's shingle set, as ascending 64-bit values."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, offsets = shingle_sets(batch.column("text"), width)
        cut = [hashes[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cut, pa.binary())], ["doc_id", "words"])

    return map_arrow(texts, run, "doc_id long, words binary", rows=500)


def _cells(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, cell, doc_id, label, minor): a row for each cell in which a member of a mixed bucket is compared.

    Cells hold a block of the bucket's largest component and one of the others (minor), or two
    blocks of the others; a cell's number tells its pair of blocks.
    """
    rows = members.join(labels, "doc_id", "left").select("key", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    groups = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("long")
    buckets = (
        groups.groupBy("key")
        .agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("labels"))
        .where("labels > 1")
        .select("key", F.col("top.label").alias("major"), blocks(F.col("top.n")).alias("majors"), blocks(F.col("all") - F.col("top.n")).alias("minors"))
    )
    mixed = rows.join(buckets, "key").withColumn("minor", F.col("label") != F.col("major"))
    own = F.pmod(F.xxhash64("doc_id"), F.when(F.col("minor"), F.col("minors")).otherwise(F.col("majors")))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    with_minors = F.transform(upto("minors"), lambda k: own * F.col("minors") + k)
    with_majors = F.transform(upto("majors"), lambda k: k * F.col("minors") + own)
    among = F.transform(upto("minors"), lambda k: -(1 + F.least(k, own) * F.col("minors") + F.greatest(k, own)))
    cells = F.when(F.col("minor"), F.concat(with_majors, among)).otherwise(with_minors)
    return mixed.select("key", F.explode(cells).alias("cell"), "doc_id", "label", "minor")


def _by_cell(dealt: DataFrame, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`work` on all rows of each cell, which come behind each other in one task."""
    dealt = dealt.repartition("key", "cell").sortWithinPartitions("key", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([rest, now]) if rest is not None else now
            key, cell = now.column("key").to_numpy(), now.column("cell").to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1
            edges = [0, *cuts]
            for lo, hi in zip(edges, cuts, strict=False):
                yield from work(now.slice(lo, hi - lo))
            rest = now.slice(edges[-1])
        if rest is not None and rest.num_rows:
            yield from work(rest)

    return dealt.mapInArrow(run, schema)


def _across(members: DataFrame, sigs: DataFrame, labels: DataFrame, least: float, percent: int, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of one bucket that link different components.

    members (key, doc_id); labels (doc_id, label), a row only where label <> doc_id; sets
    (doc_id, words).  Within a cell, components that a link joins count as one from then on,
    so that a cell gives fewer pairs than it has components.
    """

    def partners(block: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
        """Each minor row, and the rows that its size and signature allow a link with, across components."""
        ids, sizes, label = (block.column(c).to_numpy() for c in ("doc_id", "n", "label"))
        minor = block.column("minor").to_numpy()
        sig = np.frombuffer(b"".join(block.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
        in_major = block.column("cell")[0].as_py() >= 0
        for k in np.flatnonzero(minor):
            other = (label != label[k]) & (100 * np.minimum(sizes, sizes[k]) >= percent * np.maximum(sizes, sizes[k]))
            at = np.flatnonzero(other & (~minor if in_major else ids > ids[k]))
            at = at[_alike(sig[at], sig[k]) >= least]
            if len(at):
                yield k, at

    def possible(block: pa.Table) -> Iterator[pa.RecordBatch]:
        """The cell's rows that have a possible partner."""
        keep = np.zeros(block.num_rows, bool)
        for k, at in partners(block):
            keep[k] = keep[at] = True
        if keep.any():
            yield from block.filter(pa.array(keep)).combine_chunks().to_batches()

    def linked(block: pa.Table) -> Iterator[pa.RecordBatch]:
        """Confirmed links, one between two components."""
        ids, sizes = block.column("doc_id").to_numpy(), block.column("n").to_numpy()
        group = np.unique(block.column("label").to_numpy(), return_inverse=True)[1]
        words = [np.frombuffer(w, np.uint64) for w in block.column("words").to_pylist()]
        found = []
        for k, at in partners(block):
            at = at[group[at] != group[k]]
            if not len(at):
                continue
            own, theirs = words[k], np.concatenate([words[i] for i in at])
            place = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
            cuts = np.cumsum([0, *(len(words[i]) for i in at)])[:-1]
            both = np.add.reduceat((own[place] == theirs).astype(np.int64), cuts)
            at = at[100 * both >= percent * (sizes[k] + sizes[at] - both)]
            joined, first = np.unique(group[at], return_index=True)
            told = at[first]
            group[np.isin(group, joined)] = group[k]
            found.append((np.maximum(ids[told], ids[k]), np.minimum(ids[told], ids[k])))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["a", "b"])

    shape = "key long, cell long, doc_id long, label long, minor boolean, n long, sig binary"
    wide = _cells(members, labels).join(sigs.select("doc_id", "n", "sig"), "doc_id").select("key", "cell", "doc_id", "label", "minor", "n", "sig")
    left = materialize(_by_cell(wide, possible, shape), "possible")
    # sets of these rows alone; texts are scanned for them once
    wanted = sets.join(left.select("doc_id").distinct(), "doc_id", "left_semi")
    pairs = materialize(_by_cell(left.join(wanted, "doc_id"), linked, "a long, b long").distinct(), "pairs")
    drop_materialized(left)
    return pairs


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 36, rows: int = 6) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Links are pairs whose sets of `width`-word shingles have a Jaccard similarity of
    `percent` hundredths or more.  With the default bands a pair at exactly 0.8
    escapes every bucket with a probability of 2e-5.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sigs = materialize(signatures(docs, width, bands, rows), "signatures")
    usable = sigs.where("n > 0 and doc_id is not null")
    same_set = ["fp1", "fp2", "n"]
    sets_seen = materialize(usable.groupBy(*same_set).agg(F.min("doc_id").alias("rep")), "sets")
    classes = materialize(_class_ids(sets_seen), "classes")
    # from here on a class stands for its texts, under the name of doc_id
    named = usable.join(classes, same_set)
    heads = materialize(named.where("doc_id = rep").dropDuplicates(["cid"]).select(F.col("cid").alias("doc_id"), "rep", "hash", "n", "keys", "sig"), "heads")
    # ids whose rows hold different texts link their classes
    several = usable.groupBy("doc_id").agg(F.min("hash").alias("a"), F.max("hash").alias("b")).where("a <> b").select("doc_id")
    ids = named.join(several, "doc_id").select("doc_id", "cid").distinct()
    same_id = ids.join(ids.groupBy("doc_id").agg(F.min("cid").alias("v")), "doc_id").where("cid <> v").select(F.col("cid").alias("u"), "v")
    keyed = heads.select(F.explode("keys").alias("key"), "doc_id")
    buckets = keyed.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub < last").select("key", "hub")
    members = materialize(keyed.join(buckets, "key"), "members")
    wanted = members.select("doc_id").distinct().join(heads, "doc_id").select("doc_id", "rep", "hash")
    near = _only_ids(docs, wanted.select(F.col("rep").alias("doc_id"))).select(F.col("doc_id").alias("rep"), F.xxhash64("text").alias("hash"), "text")
    texts = materialize(near.join(wanted, ["rep", "hash"]).dropDuplicates(["doc_id"]).select("doc_id", "text"), "texts")
    least = _floor(percent / 100, bands * rows)

    as_edges = lambda pairs: pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    hubs = members.where("doc_id > hub").groupBy("doc_id").agg(F.min("hub").alias("b")).select(F.col("doc_id").alias("a"), "b")
    first = _confirmed(_by_signature(hubs, heads, least, percent), texts, width, percent)
    found = stars(as_edges(first).unionByName(same_id))
    labels = found.select(F.col("u").alias("doc_id"), F.col("v").alias("label"))
    apart = _across(members.select("key", "doc_id"), heads, labels, least, percent, _sets(texts, width))
    joined = stars(found.unionByName(as_edges(_confirmed(apart, texts, width, percent))))
    linked = materialize(nodes_of(joined).join(classes, F.col("node") == F.col("cid")).select("cid", "rep", "component"), "linked")
    least_ids = linked.groupBy("component").agg(F.min("rep").alias("top"))
    tops = classes.join(linked.join(least_ids, "component").select("cid", "top"), "cid", "left").select(*same_set, F.coalesce("top", "rep").alias("top"))
    out = sigs.select("doc_id", *same_set).join(tops, same_set, "left")
    out = out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("top", "doc_id")).alias("component_id"),
    )
    result = materialize(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))), "near")
    for done in (sigs, sets_seen, classes, heads, members, texts, found, apart, joined, linked):
        drop_materialized(done)
    return result
