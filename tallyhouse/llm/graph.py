"""Connected components of a distributed edge list, by hooking, pointer jumping and contraction.

Every round each node hooks to its least neighbour, the hooks are flattened by pointer jumping,
and the edges are rewritten between roots; a node that is not the least of its neighbourhood
disappears, so few rounds are needed.  All state stays in checkpointed tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.tables import materialised


def _flattened(hooks: DataFrame) -> DataFrame:
    """(node, root) from (node, root) in which every root is a node with a hook of its own."""
    while True:
        next_up = hooks.select(F.col("node").alias("root"), F.col("root").alias("upper"))
        jumped = materialised(hooks.join(next_up, "root").select("node", F.col("upper").alias("root"), (F.col("upper") != F.col("root")).alias("moved")))
        hooks = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return hooks


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs, in any direction and with repeats, to (node, component), the least node it reaches.

    Edges with a null end and loops are ignored; nodes without edges do not appear.
    """
    left = materialised(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    found = None
    while not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("other")))
        hooks = both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("root"))
        roots = _flattened(materialised(hooks))
        if found is None:
            found = roots.withColumnRenamed("root", "component")
        else:
            upper = roots.select(F.col("node").alias("component"), F.col("root").alias("upper"))
            found = found.join(upper, "component", "left").select("node", F.coalesce("upper", "component").alias("component"))
        of_a = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
        of_b = roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        left = materialised(
            left.join(of_a, "a").join(of_b, "b").where("root_a <> root_b").select(F.greatest("root_a", "root_b").alias("a"), F.least("root_a", "root_b").alias("b")).distinct()
        )
        found = materialised(found)
    if found is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found
