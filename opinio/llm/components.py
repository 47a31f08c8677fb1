"""Connected components of a link table by alternating large and small stars.

Each round is a handful of aggregations and joins on the link table; links stay
distributed, and every round is written to the shared folder, which cuts the
lineage. A node with very many links is reduced by partial ``min``; the join
that spreads the minimum is a sort-merge join that AQE can split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinio.llm.common import written


def _state(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.crc32(F.concat_ws(",", "u", "v")))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) long -> (node, root) for every node that has a link to
    another; root is the smallest node of its component. Self links and
    repeated links change nothing."""
    edges = (links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
             .distinct())
    edges = written(edges, "links")
    state = _state(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        # a node whose neighbour is not the minimum keeps its own link to the minimum
        edges = written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
