"""Connected components by alternating large-star and small-star steps.

Edges live in tables throughout; the driver learns only whether stars are all that is
left.  A star's centre may touch any share of all edges: minima are taken with
map-side combining, and in the join that brings them back nodes of more than HOT edges
are dealt over SALTS tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, filter_of, in_filter, materialize

#: Edges of a node from which they are dealt over several tasks, and over how many.
HOT, SALTS = 256, 32


def _looked_up(edges: DataFrame, node: str, other: str, values: DataFrame) -> DataFrame:
    """edges with the columns that values, of one row a node, has for `node` (null where it has none).

    Nodes with many edges are marked by a filter of a fixed 8 MB, alike on both sides, so
    that a node that it marks by mistake is dealt over several tasks as well and nothing is lost.
    """
    hot = edges.groupBy(node).count().where(F.col("count") > HOT).select(F.xxhash64(node).alias("h"))
    if hot.isEmpty():
        return edges.join(values, node, "left")
    spread = edges.sparkSession.sparkContext.broadcast(filter_of(hot))

    @F.pandas_udf("boolean")
    def marked(h: pd.Series) -> pd.Series:
        return pd.Series(in_filter(spread.value, h.to_numpy(np.int64)))

    many = marked(F.xxhash64(node))
    left = edges.withColumn("_hot", many).withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    right = values.withColumn("_hot", many).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("_hot"), SALTS - 1).otherwise(0)))).drop("_hot")
    return left.join(right, [node, "_salt"], "left").drop("_salt")


def _stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one node, and that on none: then nothing is left to do."""
    own = edges.select(F.col("u").alias("x"), F.lit(1).alias("below"))
    seen = own.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("below")))
    # a node below two others, or below one and above another, breaks a star
    roles = seen.groupBy("x").agg(F.sum("below").alias("below"), F.min("below").alias("least"))
    return roles.where("below > 1 or (below = 1 and least = 0)").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least of its neighbourhood. Edges hold u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), "m")
    return _looked_up(edges.select("u", "v"), "v", "u", least).select("u", F.coalesce("m", "v").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the least of them. Edges hold u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    near = _looked_up(edges.select("u", "v"), "u", "v", least)
    return near.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def stars(edges: DataFrame) -> DataFrame:
    """edges (u, v): undirected links of integers, repeats and loops allowed -> (u, v), materialized.

    Each node that reaches a smaller one is u once; v is the least node that it reaches.
    """
    tidy = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(tidy, "edges")
    while not _stars(now):
        large = materialize(_large_star(now).distinct(), "edges")
        new = materialize(_small_star(large).distinct(), "edges")
        drop_materialized(large)
        drop_materialized(now)
        now = new
    return now


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> (node, component): the least node that each node reaches.

    Only nodes that some edge links with another node are returned; an empty input gives
    an empty result.
    """
    return nodes_of(stars(edges))


def nodes_of(found: DataFrame) -> DataFrame:
    """Stars (u, v) -> (node, component), centres included."""
    return found.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        found.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
