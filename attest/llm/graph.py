"""Connected components of an edge table, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.llm.common import stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(a, b) -> (node, root): root is the smallest node of the component. Only nodes with an edge appear.

    Alternates large-star and small-star: each node hangs its neighbours on the smallest one it knows, as joins
    with an aggregated minimum, so that no node's neighbourhood is ever gathered. Each round is stored."""
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    for _ in range(rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        following = stored(small)
        # Done when the edges are stars: every node has one smaller neighbour, and that one none.
        open_ = following.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").limit(1).unionByName(following.join(following.select(F.col("u").alias("v")), "v", "left_semi").select("u", F.lit(1).cast("long").alias("n")).limit(1))
        edges = following
        if not open_.take(1):
            break
    else:
        raise RuntimeError("components did not settle")
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
