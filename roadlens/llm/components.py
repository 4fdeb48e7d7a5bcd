"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``k, c``: for each end of an edge ``a, b`` the smallest key it can reach (itself where it is the smallest).

    Each round is a few equi-joins of the edges; the number of rounds grows with the logarithm of the longest path.
    The driver sees only two numbers a round. An empty table gives an empty result.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        # large star: neighbours above a node move to its smallest neighbour
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours and the node itself move to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    ends = now.select(F.col("a").alias("k"), F.col("b").alias("c"))
    return stored(ends.unionByName(now.select(F.col("b").alias("k"), F.col("b").alias("c")).distinct()), "components")
