"""Connected components by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airside.sources.files import stored


def components(edges: DataFrame, scope: list[str]) -> DataFrame:
    """``scope``, id, part: the smallest id that each node of ``edges`` (scope, a, b) hangs together with, within its scope.

    Every round gives a node the smallest label around it, then the label of that label, so that labels
    travel twice as far each time; it ends when no label changes. Each round's labels are
    written, and one row of the round comes back. An edge from a node to itself makes it a part of its own.
    """
    both = stored(edges.select(*scope, "a", "b").unionByName(edges.select(*scope, F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(*scope, "a").agg(F.least(F.col("a"), F.min("b")).alias("part")).withColumnRenamed("a", "id"), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("id", "b"), [*scope, "b"]).groupBy(*scope, F.col("a").alias("id")).agg(F.min("part").alias("near"))
        near = labels.join(around, [*scope, "id"]).select(*scope, "id", "part", F.least("part", "near").alias("next"))
        jumped = near.join(labels.select(*scope, F.col("id").alias("next"), F.col("part").alias("far")), [*scope, "next"])
        moved = stored(jumped.select(*scope, "id", F.least("next", "far").alias("now"), (F.least("next", "far") < F.col("part")).alias("moved")), "labels")
        labels = moved.select(*scope, "id", F.col("now").alias("part"))
        if moved.where("moved").isEmpty():
            return labels
