"""Exact quantiles of columns of any size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values between the bounds that are put in order at last; more of them are narrowed down once more.
FEW = 100_000
#: Accuracy of the sketch, and the share of rows by which its bounds are put further out.
ACCURACY, MARGIN = 10_000, 0.0005


def exact_quantile(df: DataFrame, column: str, quantile: float) -> float | None:
    """The linear quantile of the non-null values; None without any.

    A sketch brackets the place, one pass counts what lies below and within the bracket, and of
    the values within only their counts are put in order. No task or buffer holds all values: a
    bracket with too many differing ones is bracketed again.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    total = values.count()
    if not total:
        return None
    place = quantile * (total - 1)
    ranks = math.floor(place), math.ceil(place)
    inside, below, many = values, 0, total
    while True:
        shares = [max(0.0, (ranks[0] - below) / many - MARGIN), min(1.0, (ranks[1] - below + 1) / many + MARGIN)]
        low, high = inside.agg(F.percentile_approx("v", F.array(*map(F.lit, shares)), F.lit(ACCURACY)).alias("b")).first()["b"]
        under, within, kinds = inside.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v").between(low, high)), F.approx_count_distinct(F.when(F.col("v").between(low, high), F.col("v")))).first()
        if not below + under <= ranks[0] <= ranks[1] < below + under + within:
            low, high, under, within = -math.inf, math.inf, 0, many  # the sketch was off: all that is left is put in order
            kinds = 0
        inside = inside.where(F.col("v").between(low, high)) if math.isfinite(low) else inside
        stuck = within == many
        below, many = below + under, within
        if kinds <= FEW or stuck:
            break
    counted = inside.groupBy("v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) + below  # at most about FEW rows
    found = counted.withColumn("upto", upto).agg(*[F.min(F.when(F.col("upto") > r, F.col("v"))).alias(f"v{i}") for i, r in enumerate(ranks)]).first()
    return found["v0"] + (found["v1"] - found["v0"]) * (place - ranks[0])
