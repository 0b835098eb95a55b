"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.sources.scratch import Rounds


def connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, component)`` with the smallest node of each component, by alternating large-star and small-star steps.

    ``edges(a, b)`` in any direction, ``nodes(node)`` with all nodes.  Each step is a
    map-side combined minimum and a join; the lineage is cut after each round.
    """
    rounds = Rounds(edges.sparkSession)
    e = rounds.cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    seen = None
    while True:
        mark = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
        e = both.filter("b > a").join(low, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        e = rounds.cut(e)
        low = e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), "m")
        moved = e.join(low, F.col("a") == F.col("c")).select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).filter("a <> b")
        e = rounds.cut(moved.unionAll(low.select(F.col("c").alias("a"), F.col("m").alias("b"))).distinct())
        rounds.forget(1)
    label = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
