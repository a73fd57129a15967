"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlemill.session import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: longs), where root is the smallest node it is connected to.

    Each round moves edges towards the smallest neighbour from both ends (the large-star and small-star steps of
    Kiveris et al., 2014) until the graph is a set of stars, which takes a few rounds. A round is written to
    the shared folder, so the lineage stays short and a lost executor costs one round. Smallest neighbours
    are found by an aggregation that combines within tasks; a node with very many edges is one partition
    of the join after it, which Spark splits.
    """
    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    stars = stage(edges.where("a <> b").select(high, low).distinct(), "edges")
    before = None
    while (now := _signature(stars)) != before:
        before = now
        both = stars.union(stars.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = stage(small.union(least).distinct(), "edges")
    roots = stars.select(F.col("b").alias("node")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
