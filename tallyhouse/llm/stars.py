"""Connected components by alternating large-star and small-star.

An edge is kept as (larger, smaller).  Large-star links each node's larger neighbours to the least node of its
neighbourhood, small-star its smaller neighbours and itself to the least of them.  Both keep the components; when neither
changes the edges any more, every component is a star around its least node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.tables import materialised


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    lower = edges.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return lower.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def _print_of(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
    return row["n"], row["sum"]


def star_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs, in any direction and with repeats, to (node, component), the least node it reaches.

    Edges with a null end and loops are ignored; nodes without edges do not appear.
    """
    now = materialised(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, seen = None, _print_of(now)
    while seen[0] and seen != before:
        now = materialised(_small_star(_large_star(now)))
        before, seen = seen, _print_of(now)
    centres = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(centres.select("node", F.col("node").alias("component")))
