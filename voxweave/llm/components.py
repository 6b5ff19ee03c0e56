"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxweave.runtime import cut


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> node, root: the smallest node reachable, for each node that has an edge.

    In each round every node hooks to its smallest neighbour if that is smaller, then to what the neighbour hooked to,
    and edges inside of what became one node are dropped, so that the graph shrinks by a factor each round. Every round
    is checkpointed. No edges: no rows.
    """
    def tidy(e: DataFrame) -> DataFrame:
        return cut(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())

    left = tidy(edges)
    labels = left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    while not left.isEmpty():
        hook = left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))
        further = hook.select(F.col("node").alias("to"), F.col("to").alias("next"))
        hook = cut(hook.join(further, "to", "left").select("node", F.coalesce("next", "to").alias("to")))
        moved = left.join(hook.select(F.col("node").alias("b"), F.col("to").alias("b_to")), "b").join(
            hook.select(F.col("node").alias("a"), F.col("to").alias("a_to")), "a", "left")
        left = tidy(moved.select(F.coalesce("a_to", "a").alias("a"), F.col("b_to").alias("b")))
        labels = labels.join(hook.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return cut(labels)
