"""Connected components of an undirected graph by alternating large-star and small-star steps.

Every step groups edges by an end, finds its least neighbour and hangs the others to that. Links and components
stay on the executors; each step's edges are written to the shared folder, so that a lost executor costs one step.
Both steps join edges with one row per node, which lets Spark split a node with very many edges. The steps end when the edges are stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightline.functions.materialise import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node of its component, for every node of edges (a, b: of one ordered type).

    Nulls, loops and repeated edges are of no effect; without edges the result is empty.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialise(now, "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("root").alias("b"))
        large = large.where("a <> b").distinct()
        # Every edge of large has a > b: a's lower neighbours and a itself hang to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("root"))
        small = large.join(least, "a")
        small = small.select("a", F.col("root").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("root").alias("b")))
        step = materialise(small.where("a <> b").distinct(), "edges")
        discard(now)
        now = step
    # Of a star the edges go from each node to the centre, its least node.
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node of edges (a > b) is either a centre, that is a b and no a, or has one edge, to a centre."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 OR up > 0 AND down > 0").isEmpty()
