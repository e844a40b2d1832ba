"""Connected components of a graph in Spark, by alternating large and small stars.

Nothing is collected: each round is two groupings and a join on a table of edges that only
shrinks in depth; lineage is cut by checkpoint() in each round. Groupings are pre-aggregated, and the joins
are plain ones that adaptive execution can split where a node has very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import durable

ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) with a > b. Large: every larger neighbour goes to the least one; small: smaller ones do."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        # An edge (a, b) makes a go to the least neighbour of b; b's own edges run both ways.
        out = edges.join(least, F.col("b") == F.col("u")).select("a", F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        out = edges.join(least, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    return out.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the least node that can be reached.

    Edges may run either way and repeat; loops count for nothing. No edges give no rows.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    now = durable(now)
    mark = None
    for _ in range(ROUNDS):
        now = durable(_star(_star(now, True), False))
        # Done when a round changes nothing: every node then has one edge, to its root.
        new = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).collect()[0]
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
