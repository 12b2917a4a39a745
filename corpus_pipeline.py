"""The corpus pipeline: documents through five stages to a training mix.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
Columns of docs beyond those of documents come through every stage, whatever their names.
Stages tell rows apart by their id and text, not by the id alone: rows without an id and
rows that repeat one with another text are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mixing, secrets, toxicity
from tessera.llm.common import drop_materialized, leftovers, materialize, table
from tessera.llm.minhash import near_duplicates


def _key() -> Column:
    """What names a document: a 64-bit hash of its id and text (null ones included)."""
    return F.xxhash64(F.lit("document"), "doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull())


def _with(docs: DataFrame, **columns: Column) -> DataFrame:
    """The rows of docs as one struct column `row`, and other columns beside it."""
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(held, *[c.alias(name) for name, c in columns.items()])


def _rows(held: DataFrame, docs: DataFrame) -> DataFrame:
    return held.select(*[F.col(f"row.`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below 0.7; the scores are learned from all labels.

    Null and empty texts, repeated rows and very long texts are scored like any other; without
    labels of both classes all documents stay, unless all labels are toxic; an empty table stays empty.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8): that of the least id, null ids last.

    Of rows with the same id and text the least by the other columns stays; texts without words are
    near copies of nothing; of texts that share the least id, one chosen by a hash stays.
    """
    near = near_duplicates(docs.select(_key().alias("doc_id"), "text"), width=5, percent=80)
    found = materialize(near.select(F.col("doc_id").alias("key"), "component_id").distinct(), "groups")
    named = docs.select(_key().alias("key"), F.col("doc_id").alias("id")).distinct().join(found, "key")
    kept = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("first")).select("first.key")
    held = _with(docs, key=_key()).join(kept, "key", "left_semi")
    if any("map<" in kind for _, kind in docs.dtypes):  # maps have no order
        one = held.dropDuplicates(["key"])
    else:
        one = held.groupBy("key").agg(F.min("row").alias("row"))
    return _rows(one, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; each text is judged on its own, whatever its id.

    Null and empty texts hold none; repeated rows go or stay together; without items all stay.
    """
    texts = docs.where("text is not null").select(_key().alias("doc_id"), "text")
    leaks = decontaminate.contaminated(texts, table(spark, sf_dir, "benchmark"))
    return _rows(_with(docs, key=_key()).join(leaks.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti"), docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts; null and empty texts stay as they are."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns and block, place: as often and in the order in which the mix uses them.

    Documents without text have no place in the mix; a null source is the source ''.
    """
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: Components and trained scores are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written and read again.

    The tables that a stage leaves behind, its input's included, go when its result is written.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with leftovers(spark) as keep:
            made = materialize(stage(spark, docs, sf_dir), name)
            keep(made)
        if docs.inputFiles() and name != STAGES[0][0]:
            drop_materialized(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
