"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def _stars(pairs: DataFrame, keep: str) -> DataFrame:
    """Join each node's neighbours (``node``, ``other``) to the least of node and neighbours."""
    least = pairs.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("m"))
    return pairs.join(least, "node").where(keep)


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a < b); root is the least of its component.

    Each round writes one table of edges.  A round takes partial minima per node and an
    equi-join, so a node with very many edges is never held in one place.  Rounds go on
    until nothing changes; their number grows with the logarithm of the longest path.
    """
    now = edges.select(F.col("b").alias("node"), F.col("a").alias("other"))  # other < node
    before = None
    while True:
        both = now.union(now.select(F.col("other").alias("node"), F.col("node").alias("other")))
        large = (_stars(both, "other > node").select(F.col("other").alias("node"), F.col("m").alias("other"))
                 .where("node > other").distinct())
        large = stored(large, "large")
        least = large.groupBy("node").agg(F.min("other").alias("m"))
        small = large.join(least, "node").select(F.when(F.col("other") == F.col("m"), F.col("node"))
                                                 .otherwise(F.col("other")).alias("node"),
                                                 F.col("m").alias("other")).where("node > other").distinct()
        now = stored(small, "small")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("node", "other").cast("decimal(20,0)")),
                        F.count_distinct("node")).first()
        if state == before or state[0] == state[2] and not _deep(now):
            break
        before = state
    tops = now.select(F.col("other").alias("node")).distinct()
    return now.select("node", F.col("other").alias("root")).union(tops.select("node", F.col("node").alias("root")))


def _deep(edges: DataFrame) -> bool:
    """True if some root is itself a node below another."""
    return bool(edges.select("other").distinct()
                .join(edges.select(F.col("node").alias("other")), "other", "left_semi").limit(1).count())
