"""Queries of categorical data, rules, partitions and distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import categorical as cat
from tessera.operators import partition as part
from tessera.operators.classifier import EnsembleClassifier, Entailment, accuracy, validate_premises
from tessera.operators.frames import table

from .registry import plain, query, rounded

_BOOK = "book AS (SELECT label, row_number() OVER (ORDER BY min(k)) - 1 AS code FROM (SELECT c_custkey AS k, c_mktsegment AS label FROM customer) GROUP BY label)"


def _customers(spark: SparkSession, sf_dir: str) -> cat.CategoricalFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.concat(F.lit("N"), F.col("c_nationkey")).alias("nation"))
    return cat.encode(df, "c_custkey", ["c_mktsegment", "nation"])


@query(f"WITH {_BOOK} SELECT c_custkey AS row_id, code::DOUBLE AS code FROM customer JOIN book ON c_mktsegment = label")
def cat_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).rows.select("row_id", F.col("c_mktsegment").alias("code"))


@query(f"WITH {_BOOK} SELECT 'c_mktsegment' AS variable, code::DOUBLE AS code, label FROM book")
def cat_codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).codebook.where("variable = 'c_mktsegment'")


@query("SELECT c_custkey AS row_id, c_mktsegment, 'N' || c_nationkey AS nation FROM customer")
def cat_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).decode()


@query("SELECT c_custkey AS row_id, (c_mktsegment = s)::INTEGER::DOUBLE AS flag, s AS label FROM customer, (SELECT DISTINCT c_mktsegment AS s FROM customer)")
def cat_disjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _customers(spark, sf_dir).slice(variables=["c_mktsegment"])
    wide = data.disjoin()
    pairs = F.array(*[F.struct(F.col(f"`{c}`").alias("flag"), F.lit(c.split("=", 1)[1]).alias("label")) for c in wide.columns if c != "row_id"])
    return wide.select("row_id", F.explode(pairs).alias("p")).select("row_id", "p.*")


@query("SELECT s AS row_label, t AS column_label, count(c_custkey)::BIGINT AS cells FROM (SELECT DISTINCT c_mktsegment AS s FROM customer) CROSS JOIN (SELECT DISTINCT c_nationkey, 'N' || c_nationkey AS t FROM customer) k LEFT JOIN customer c ON c_mktsegment = s AND c.c_nationkey = k.c_nationkey GROUP BY s, t")
def cat_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _customers(spark, sf_dir).contingency("c_mktsegment", "nation")
    return found.select("row_label", "column_label", F.col("n").alias("cells"))


@query("SELECT lang, source, count(*)::BIGINT AS n FROM documents GROUP BY lang, source")
def cat_contingency_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    found = cat.encode(df, "doc_id", ["lang", "source"]).contingency("lang", "source")
    return found.where("n > 0").select(F.col("row_label").alias("lang"), F.col("column_label").alias("source"), "n")


@query("SELECT c_custkey, CASE WHEN c_acctbal <= 0 THEN ']-Inf, 0]' WHEN c_acctbal <= 5000 THEN ']0, 5000]' ELSE ']5000, Inf[' END AS band FROM customer")
def cat_categorizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers categorised by intervals, encoded and decoded again."""
    df = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("band"))
    return cat.encode(df, "c_custkey", ["band"], {"band": cat.interval_label([0.0, 5000.0])}).decode().withColumnRenamed("row_id", "c_custkey")


@query("SELECT o_orderkey, epoch_ms(o_orderdate)::DOUBLE AS o_orderdate FROM orders")
def cat_encode_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return cat.encode_numbers(df, ["o_orderdate"], {"o_orderdate": cat.date_codifier})


@query("SELECT p_size::DOUBLE AS value, count(*)::BIGINT AS n, count(DISTINCT p_brand)::BIGINT AS targets, CASE WHEN count(DISTINCT p_brand) = 1 THEN min(p_brand) END AS pure FROM part GROUP BY p_size")
def cat_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.bins(table(spark, sf_dir, "part"), "p_size", "p_brand").select("value", "n", F.size("counts").cast("long").alias("targets"), "pure")


@query(
    """WITH b AS (SELECT p_retailprice AS v, count(*) AS n, CASE WHEN count(DISTINCT p_brand) = 1 THEN min(p_brand) END AS t FROM part GROUP BY p_retailprice),
    f AS (SELECT *, CASE WHEN t IS NOT NULL AND t = lag(t) OVER (ORDER BY v) THEN 0 ELSE 1 END AS new FROM b),
    g AS (SELECT *, sum(new) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) - 1 AS block FROM f)
    SELECT block::BIGINT AS block, min(v)::DOUBLE AS low, max(v)::DOUBLE AS high, sum(n)::BIGINT AS n, min(t) AS target FROM g GROUP BY block"""
)
def cat_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.blocks(table(spark, sf_dir, "part"), "p_retailprice", "p_brand").withColumn("block", F.col("block").cast("long"))


@query(
    """WITH c AS (SELECT (max(p_size) FILTER (WHERE p_size <= 17) + min(p_size) FILTER (WHERE p_size > 17)) / 2.0 AS a, (max(p_size) FILTER (WHERE p_size <= 34) + min(p_size) FILTER (WHERE p_size > 34)) / 2.0 AS b FROM part)
    SELECT p_partkey, CASE WHEN p_size <= a THEN printf(']-Inf, %g]', a) WHEN p_size <= b THEN printf(']%g, %g]', a, b) ELSE printf(']%g, Inf[', b) END AS p_size, ']-Inf, Inf[' AS p_retailprice FROM part, c"""
)
def cat_entropy_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes are cut where bands of sizes part; prices, which say nothing of them, nowhere."""
    df = table(spark, sf_dir, "part").withColumn("band", F.when(F.col("p_size") <= 17, "small").when(F.col("p_size") <= 34, "middle").otherwise("large"))
    found = cat.entropy_categorizers(df, ["p_size", "p_retailprice"], "band")
    return df.select("p_partkey", *[f(F.col(c)).alias(c) for c, f in found.items()])


@query("SELECT c_custkey AS row_id, (c_mktsegment = 'BUILDING')::INTEGER::DOUBLE AS flag FROM customer WHERE c_custkey % 3 = 0")
def cat_disjoin_supplementary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the customers by the categories of the others."""
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    data = cat.encode(df.where("c_custkey % 3 <> 0"), "c_custkey", ["c_mktsegment"])
    book = data.codebook.select(F.col("label").alias("c_mktsegment"), F.col("code"))
    more = df.where("c_custkey % 3 = 0").join(book, "c_mktsegment").select(F.col("c_custkey").alias("row_id"), F.col("code").alias("c_mktsegment"))
    return data.disjoin(supplementary=more).select("row_id", F.col("`c_mktsegment=BUILDING`").alias("flag"))


@query("SELECT label AS part, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS members FROM embeddings GROUP BY label")
def part_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = part.by_value(table(spark, sf_dir, "embeddings"), "vec_id", "label")
    return found.select("part", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query("SELECT c_mktsegment AS segment, c_nationkey AS nation, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS members FROM customer GROUP BY 1, 2")
def part_by_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = part.by_rows(table(spark, sf_dir, "customer"), "c_custkey", ["c_mktsegment", "c_nationkey"])
    return found.select(F.col("part.c_mktsegment").alias("segment"), F.col("part.c_nationkey").alias("nation"), F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query("SELECT vec_id % 7 AS part, count(*)::BIGINT AS n, min(vec_id) AS first FROM embeddings GROUP BY 1")
def part_by_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = part.by_function(table(spark, sf_dir, "embeddings"), "vec_id", lambda i: i % 7)
    return found.select("part", F.size("members").cast("long").alias("n"), F.get("members", F.lit(0)).alias("first"))


_PAIRS = """p AS (SELECT vec_id, label::VARCHAR AS label, [x::DOUBLE FOR x IN embedding] AS x FROM embeddings),
d AS (SELECT least(a.label, b.label) AS a, greatest(a.label, b.label) AS b, list_distance(a.x, b.x) AS d FROM p a JOIN p b ON a.vec_id < b.vec_id)"""


@query(f"WITH {_PAIRS} SELECT a, b, round(min(d), 6) + 0.0 AS single, round(max(d), 6) + 0.0 AS complete, round(avg(d), 6) + 0.0 AS average FROM d WHERE a < b GROUP BY a, b")
def dist_linkages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single, complete and average linkage of each pair of labels."""
    return rounded(part.linkages(table(spark, sf_dir, "embeddings"), "label", "embedding"), 6)


@query(f"WITH {_PAIRS} SELECT a AS part, round(max(d), 6) + 0.0 AS diameter FROM d WHERE a = b GROUP BY a")
def dist_diameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(part.diameters(table(spark, sf_dir, "embeddings"), "label", "embedding"), 6)


@query("SELECT a.s_suppkey AS left, b.s_suppkey AS right, round(abs(a.s_acctbal - b.s_acctbal), 4) + 0.0 AS distance FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey".replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'))
def dist_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "supplier").select("s_suppkey", F.array("s_acctbal").alias("x"))
    return rounded(part.distances(df, "s_suppkey", "x"), 4)


_CENTRES = """e AS (SELECT label, vec_id, unnest(range(64)) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings),
c AS (SELECT label, j, avg(v) AS m FROM e GROUP BY label, j),
g AS (SELECT a.label AS a, b.label AS b, sqrt(sum((a.m - b.m) ** 2)) AS d FROM c a JOIN c b USING (j) WHERE a.label <> b.label GROUP BY 1, 2)"""


@query(f"WITH {_CENTRES} SELECT a, b, round(d, 6) + 0.0 AS distance FROM g WHERE a < b")
def dist_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(part.centroid_linkages(table(spark, sf_dir, "embeddings"), "label", "embedding", 64), 6)


@query(f"WITH {_CENTRES} SELECT round(min(d), 6) + 0.0 AS minimum_centroid_linkage FROM g")
def part_min_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(part.minimum_centroid_linkage(table(spark, sf_dir, "embeddings"), "label", "embedding", 64), 6)


@query(f"WITH {_PAIRS} SELECT round(min(d) FILTER (WHERE a < b) / max(d) FILTER (WHERE a = b), 6) + 0.0 AS dunn_index FROM d")
def part_dunn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(part.dunn_index(table(spark, sf_dir, "embeddings"), "label", "embedding"), 6)


@query(
    f"""WITH {_CENTRES}, r AS (SELECT label, vec_id, sqrt(sum((v - m) ** 2)) AS d FROM e JOIN c USING (label, j) GROUP BY 1, 2), s AS (SELECT label, avg(d) AS s FROM r GROUP BY label)
    SELECT round(avg(m), 6) + 0.0 AS davies_bouldin_index FROM (SELECT g.a, max((x.s + y.s) / d) AS m FROM g JOIN s x ON x.label = g.a JOIN s y ON y.label = g.b GROUP BY g.a)"""
)
def part_davies_bouldin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(part.davies_bouldin_index(table(spark, sf_dir, "embeddings"), "label", "embedding", 64), 6)


_RETURN = ["A", "N", "R"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.array_position(F.array(*map(F.lit, _RETURN)), F.col("l_returnflag")).cast("double")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", flag.alias("flag"), (F.col("l_linestatus") == "O").cast("double").alias("status"), F.least(F.floor(F.col("l_quantity") / 10), F.lit(4)).cast("double").alias("size"))


_DOMAINS = ((1.0, 2.0, 3.0), (0.0, 1.0, 2.0, 3.0, 4.0))
_RULES = [([{1.0, 3.0}, set()], 0.0, 0.9), ([{2.0}, {0.0, 1.0}], 1.0, 0.8), ([set(), {4.0}], 0.0, 0.3), ([{2.0}, {2.0, 3.0, 4.0}], 1.0, 0.7)]


def _ensemble() -> EnsembleClassifier:
    found = EnsembleClassifier(("flag", "size"), _DOMAINS, "status", (0.0, 1.0))
    for premises, conclusion, truth in _RULES:
        found.add(premises, conclusion, truth)
    return found


_LINES = "l AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 3 ELSE 0 END AS flag, (l_linestatus = 'O')::INTEGER AS status, least(floor(l_quantity / 10), 4) AS size FROM lineitem)"
_VOTED = f"{_LINES}, v AS (SELECT *, CASE WHEN flag IN (1, 3) THEN 0.9 ELSE 0 END + CASE WHEN size = 4 THEN 0.3 ELSE 0 END AS v0, CASE WHEN flag = 2 AND size IN (0, 1) THEN 0.8 ELSE 0 END + CASE WHEN flag = 2 AND size IN (2, 3, 4) THEN 0.7 ELSE 0 END AS v1 FROM l)"


@query(f"WITH {_LINES} SELECT count(*)::BIGINT AS n, min(l_orderkey) AS first FROM l WHERE flag = 2 AND size IN (0, 1)")
def entail_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Entailment((frozenset({2.0}), frozenset({0.0, 1.0})), 1.0)
    held = validate_premises(_lines(spark, sf_dir), "l_orderkey", rule, ["flag", "size"], _DOMAINS)
    return held.agg(F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("first"))


@query(f"WITH {_VOTED} SELECT flag::DOUBLE AS flag, size::DOUBLE AS size, CASE WHEN v0 >= v1 THEN 0 ELSE 1 END::DOUBLE AS predicted, count(*)::BIGINT AS n FROM v GROUP BY ALL")
def entail_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ensemble().classify(_lines(spark, sf_dir)).groupBy("flag", "size", "predicted").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_VOTED} SELECT round(avg((CASE WHEN v0 >= v1 THEN 0 ELSE 1 END = status)::INTEGER), 9) + 0.0 AS accuracy FROM v")
def entail_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(accuracy(_ensemble().classify(_lines(spark, sf_dir)), "predicted", "status"), 9)


@query(f"WITH {_LINES}, s AS (SELECT avg(status) AS s FROM l) SELECT round(greatest(s, 1 - s), 6) + 0.0 AS commonest, true AS reached FROM s")
def entail_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rules learned from lineitem reach what the commonest answer does, at least."""
    found = EnsembleClassifier(("flag", "size"), _DOMAINS, "status", (0.0, 1.0))
    lines = _lines(spark, sf_dir)
    found.train(lines, 2, seed=3)
    share = lines.agg(F.avg("status").alias("s")).select(F.greatest(F.col("s"), 1 - F.col("s")).alias("commonest"))
    reached = accuracy(found.classify(lines), "predicted", "status").first().accuracy
    return share.select(plain(F.col("commonest"), 6).alias("commonest"), (F.lit(reached) >= F.col("commonest") - 1e-9).alias("reached"))
