"""Connected components by alternating large-star and small-star steps on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airside.llm.common import join_hot, materialise


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node connected to it) for every node of ``edges`` (a, b).

    Each step hangs neighbours on the smallest one around them; edges never multiply. It ends
    when all edges lead to roots; each step's edges are written, so no plan grows with the
    rounds. Minima are combined before the shuffle, and a hub's edges are dealt to several tasks.
    """
    e = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    many = e.count()
    while many:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = join_hot(both, least.drop("n"), least, "a", "b", 2 * many).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        hung = join_hot(large, low.drop("n"), low, "a", "b", many).select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialise(hung.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "small")
        # Done if every node hangs on one that hangs on none.
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        many, deep = ends.agg(F.sum("up"), F.count_if(F.expr("up > 1 OR up = 1 AND down = 1"))).first()
        if not deep:
            break
    roots = e.select(F.col("b").alias("node")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
