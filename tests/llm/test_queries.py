"""The training-data queries and the pipeline on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from tessera.llm.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_duckdb(spark, name):
    db = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, str(DATA))
    expected = db.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(expected.columns) == columns
    rows = sorted(repr([r[c] for c in columns]) for r in df.collect())
    assert rows == sorted(repr([r[expected.columns.index(c)] for c in columns]) for r in expected.fetchall())


@pytest.mark.parametrize("name", ["op1_langid", "op3_secrets", "op4_toxicity", "op10_quality"])
def test_a_row_for_each_document(spark, name):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = QUERIES[name](spark, str(DATA))
    assert sorted(r.doc_id for r in found.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_pipeline(spark):
    """Each stage does its own work on what it gets, and no other."""
    from tessera.llm import decontaminate, mixing, secrets, toxicity
    from tessera.llm.minhash import near_duplicates

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    held = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held[-1], str(DATA)).cache()
        assert out.columns[:5] == docs.columns
        held.append(out)
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in held]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    labels = spark.read.parquet(f"{DATA}/labels.parquet").selectExpr("doc_id", "toxic label")
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    assert ids[1] == {r.doc_id for r in scored.where("score < 0.7").collect()}
    near = near_duplicates(held[1], width=5, percent=80)
    assert ids[2] == {r.doc_id for r in near.where("kept").collect()} and held[2].count() == len(ids[2])
    leaks = decontaminate.contaminated(held[2], spark.read.parquet(f"{DATA}/benchmark.parquet"))
    assert ids[3] == ids[2] - {r.doc_id for r in leaks.collect()}
    assert ids[4] == ids[3]
    found = {r.doc_id: r for r in secrets.find_secrets(held[3]).collect()}
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in held[3:5])
    for i, text in before.items():
        assert after[i] == secrets.covered(text, [(s.start, s.end, s.kind) for s in found[i].found])
    quotas = {r.source: r for r in mixing.weights(held[4]).collect()}
    assert {r.source for r in held[5].select("source").distinct().collect()} <= set(quotas)
    assert names == ["toxicity", "near_duplicates", "decontamination", "secrets", "mixing"]
    assert corpus_pipeline.run(spark, str(DATA)).count() == held[5].count()


def odd_documents(spark):
    """Rows with nulls, repeated rows and ids, long and empty texts, and columns named as the operators' own."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first = docs.orderBy("doc_id").first()
    leak = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").first().text
    words = " ".join(f"word{k}" for k in range(60))
    made = [
        (None, None, None, None, None), (None, "", None, None, None), (None, f"{words} without an id", None, "a", 5), (None, f"{words} without an id", None, "a", 5),
        (None, f"before it {leak} after it", None, "a", 5), (first.doc_id, "another text of this id, of which no copy is about", "en", "b", 7), (10**9, f"{words.replace('word', 'long')} " * 2000, "en", "b", 7),
        (10**9 + 1, f"the same key is 'secret=abcdefghij0123456789' here {words[::-1]}", "en", "b", 7), (10**9 + 2, words, "en", "b", 7), (10**9 + 2, words, "en", "b", 7),
    ]
    odd = docs.unionByName(spark.createDataFrame(made, docs.schema)).repartition(3)
    names = ("row", "key", "hash", "label", "score", "block", "place", "tie", "component_id", "kept", "item_id", "w")
    return odd.withColumns({n: F.lit("mine") for n in names}), words, leak, first.doc_id


def test_pipeline_stages_on_odd_documents(spark):
    docs, words, leak, repeated = odd_documents(spark)
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, str(DATA)).cache()
        rows = docs.collect()
        found[name] = rows
        if name != "mixing":
            assert docs.columns == before.columns
        assert all(r.key == r.row == r.hash == r.kept == "mine" for r in rows)
    texts = {name: [(r.doc_id, r.text) for r in rows] for name, rows in found.items()}
    assert texts["toxicity"].count((None, None)) == 1 and texts["toxicity"].count((10**9 + 2, words)) == 2
    near = texts["near_duplicates"]
    for kept in ((None, None), (None, ""), (repeated, "another text of this id, of which no copy is about")):
        assert near.count(kept) == 1
    # one document of each group: the id is known and the least; rows of one id and text count once
    assert near.count((None, f"{words} without an id")) == 0 and near.count((10**9 + 2, words)) == 1
    clean = texts["decontamination"]
    assert not any(leak in (t or "") for _, t in clean) and any(i == repeated and t.startswith("another") for i, t in clean)
    assert set(near) - set(clean) <= {(i, t) for i, t in near if t}
    redacted = dict(texts["secrets"])
    assert "[assign]" in redacted[10**9 + 1] and "abcdefghij0123456789" not in redacted[10**9 + 1] and len(texts["secrets"]) == len(clean)
    assert {r.block_in for r in found["mixing"]} == {"mine"} and all(r.text for r in found["mixing"])


def test_pipeline_keeps_no_tables(spark):
    from pathlib import Path

    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(folder.iterdir())
    corpus_pipeline.run(spark, str(DATA)).count()
    assert {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before} <= {"secrets", "plan"}


def test_pipeline_on_no_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(DATA))
    assert docs.count() == 0
