"""Shared helpers of the training-data operators: tables, shared storage, bounded samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Hash space used for deterministic Bernoulli samples.
_SPACE = 1 << 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; read by Spark only, so any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where the session names none a temporary folder is made and set if driver and
    executors are one machine (local masters, as in tests); on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of `df`: write it as Parquet to the shared folder and reread it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders of the tables that were materialized in this session.
_MADE: list[str] = []


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _MADE[:] = [made for made in _MADE if made.rsplit("/", 1)[1] != folder.rsplit("/", 1)[1]]


def drop_materialized(df: DataFrame) -> None:
    """Delete the files behind a materialized frame that nothing will read again."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


@contextmanager
def leftovers(spark: SparkSession) -> Iterator[Callable[[DataFrame], None]]:
    """Delete the tables that are materialized inside, at the end, except those given to `keep`."""
    before, kept = set(_MADE), set()

    def keep(df: DataFrame) -> None:
        kept.update(f.rsplit("/", 2)[1] for f in df.inputFiles())

    yield keep
    for folder in [made for made in _MADE if made not in before and made.rsplit("/", 1)[1] not in kept]:
        _delete(spark, folder)


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus` (the contracts' split of rows)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % modulus


#: Classes that labels may have, at most: a row for each reaches the driver.
CLASSES = 10_000


def _shares(df: DataFrame, strata: str, bound: int) -> dict:
    """By stratum, how many of the _SPACE draws keep a row."""
    counts = df.groupBy(strata).count().limit(CLASSES + 1).collect()
    if len(counts) > CLASSES:
        raise ValueError(f"more than {CLASSES} classes")
    return {r[0]: _SPACE if r[1] <= bound else int(_SPACE * bound / r[1]) for r in counts}


def weighted_sample(df: DataFrame, keys: list[str], bound: int, strata: str, salt: str = "sample") -> tuple[DataFrame, dict]:
    """About `bound` rows of each stratum, chosen by a hash of `keys` (all where there are fewer),
    and the rows that a kept row of each stratum stands for.

    Only used to fit classifiers.  A first, column-pruned pass counts the rows, so that
    the sample's size doesn't depend on the table's.  Rows of equal keys are one row.
    """
    draw = F.pmod(F.xxhash64(*keys, F.lit(salt)), F.lit(_SPACE))
    shares = _shares(df, strata, bound)
    keep = F.lit(False)
    for value, share in shares.items():
        keep = keep | (F.col(strata).eqNullSafe(F.lit(value)) & (draw < share))
    return df.where(keep).dropDuplicates([*keys, strata]), {value: _SPACE / max(1, share) for value, share in shares.items()}


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int) -> tuple[DataFrame, dict]:
    """docs (doc_id, text) and labels (doc_id, label) -> (text, label) of about `bound` documents a label, materialized,
    and the documents that a row of each label stands for.

    The sampled labels are what is broadcast.  Where many rows repeat a sampled id, its rows are sampled in turn.
    """
    usable = labels.where("label is not null and doc_id is not null").select("doc_id", F.col("label").cast("int").alias("label")).distinct()
    known, first = weighted_sample(usable, ["doc_id"], bound, "label")
    found = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(known), "doc_id")
    held = materialize(found.dropDuplicates(["doc_id", "text", "label"]), "labelled")
    rows, second = weighted_sample(held, ["doc_id", "text"], bound, "label", "rows")
    return rows.select("text", "label"), {value: first[value] * n for value, n in second.items()}


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, rows: int = 1000) -> DataFrame:
    """mapInArrow over slices of at most `rows` rows, so that long texts don't pile up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield fn(batch.slice(at, rows))

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null reads as empty."""
    return ["" if t is None else t for t in batch.column(name).to_pylist()]


#: Bits of a fixed-size filter over 64-bit hashes (8 MB, whatever the number of hashes).
FILTER_BITS = 1 << 26


def filter_of(hashes: DataFrame) -> np.ndarray:
    """The filter of a one-column frame of well-mixed 64-bit hashes, built with map-side combining."""
    slot = F.pmod(F.col(hashes.columns[0]), F.lit(FILTER_BITS)) + 1  # bucket k holds (k - 1) * 32768 + 1 and on
    parts = (
        hashes.select(slot.alias("b"))
        .groupBy(F.bitmap_bucket_number("b").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
        .collect()
    )
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for bucket, held in parts:
        bits[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bytes(held), np.uint8)
    return bits


def in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False only for 64-bit hashes that the filter doesn't hold."""
    x = hashes.view(np.uint64) & np.uint64(FILTER_BITS - 1)
    return ((bits[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
