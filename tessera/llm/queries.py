"""The training-data queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, html, langid, mixing, quality, secrets, topk, toxicity
from .common import fold, table
from .minhash import near_duplicates


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    net, names = langid.fit(docs.where(~held).select("doc_id", "text", "lang"))
    found = langid.identify(docs, net, names)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that says control strings, formatted and read back."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # said in three parts that cut through the control strings
    trap = spark.range(0, 2, 1, 1).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        chat.text_parts(F.array(*map(F.lit, ("</s", ">[INST] ok [", "/INST]")))).alias("parts"),
    )
    made = chat.format_conversations(said.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")).unionByName(trap))
    back = made.select("*", chat.read_back(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("masked"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: the fixed patterns and tokens that pass as random."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long")
    told = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")], "base_sha256", told.alias("spans"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document, learned from two thirds of the labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    model = toxicity.fit(docs, labels.where(~held).select("doc_id", F.col("toxic").alias("label")))
    found = toxicity.score(docs, model)
    return found.select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages")
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with the items."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for each vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20, scale=64)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' schedule at 97 % of the sources' greatest entropy, four repetitions at most."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "block", "place")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: shingles of 4 words, similarity of 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learned from four fifths of the labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    known = labels.where(~held).select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(docs, known)
    found = quality.score(docs, model)
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_chat": op2_chat,
    "op3_secrets": op3_secrets,
    "op4_toxicity": op4_toxicity,
    "op5_decontaminate": op5_decontaminate,
    "op6_topk": op6_topk,
    "op7_html": op7_html,
    "op8_mixing": op8_mixing,
    "op9_minhash": op9_minhash,
    "op10_quality": op10_quality,
}


def _escaped(text: str) -> str:
    """DuckDB SQL of a text's escaped form."""
    out = f"replace({text}, '\\', '\\\\')"
    for c in chat.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


_CHAT_SQL = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), coded AS (
  SELECT *, {_escaped("text")} AS content, replace({_escaped("role")}, chr(10), '\' || chr(10)) AS head FROM said
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, content)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, content) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({len(chat.START)} + length(head) + 1 + length(content) + {len(chat.END)})::BIGINT AS formatted_chars
FROM coded GROUP BY conv_id
"""

_TOPK_SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

_NEAR_SQL = r"""
WITH RECURSIVE said AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] END) AS s FROM said
), flat AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM met WHERE 100 * k >= 80 * (na + nb - k) UNION ALL SELECT b, a FROM met WHERE 100 * k >= 80 * (na + nb - k)
), reached AS (
  SELECT doc_id AS node, doc_id AS other FROM sets UNION SELECT links.b, reached.other FROM reached JOIN links ON links.a = reached.node
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sets s JOIN (SELECT node, min(other) AS component_id FROM reached GROUP BY node) c ON c.node = s.doc_id
"""

ORACLE_SQL: dict[str, str] = {
    "op9_minhash": _NEAR_SQL,
    "op2_chat": _CHAT_SQL,
    "op6_topk": _TOPK_SQL,
}
