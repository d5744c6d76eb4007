"""Connected components of a graph given as links, by alternating star contractions; nothing is held on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from depotflow.llm.common import stage


def _stars(edges: DataFrame) -> bool:
    """Does every node of the different edges (u, v < u) either have one edge down or none at all? Then all components are stars."""
    ends = edges.select("u", F.lit(1).alias("down")).unionAll(edges.select(F.col("v").alias("u"), F.lit(0).alias("down")))
    seen = ends.groupBy("u").agg(F.sum("down").alias("down"), F.count(F.lit(1)).alias("all"))
    return not seen.filter("down > 1 or (down = 1 and all > 1)").limit(1).count()


def components(links: DataFrame) -> DataFrame:
    """(node, label: smallest node of its component) for every node of the links (src, dst).

    Each round first joins every node's larger neighbours to its smallest neighbour, then its smaller ones; the number of
    rounds grows with the logarithm of the longest chain. A round reads and writes staged tables, so a lost executor
    costs a rerun of its tasks only. Self links and repeated links are harmless; no links give an empty result.
    """
    edges = stage(
        links.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    )
    while not _stars(edges):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(small.unionAll(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
    # now every component is a star around its smallest node
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
