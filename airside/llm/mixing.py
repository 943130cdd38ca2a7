"""Mixing sources to target weights by iterative proportional fitting (operator 10).

Documents fall into cells of equal source, language and topic. The cells' token weights are
raked in turn to the target shares of each marginal; the ratio of a cell's fitted to its
actual weight, scaled so that the largest is 1, is the probability with which its documents
are kept, so that the expected token mix is the fitted one. All of it is DataFrame
operations: one pass to sum the cells, window sums over the small cell table, one join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airside.llm.common import materialise

DIMENSIONS = ("source", "lang", "topic")
ROUNDS = 20
#: Cells are raked in one partition up to this many, and sent to all executors up to that many.
CELLS_IN_ONE, CELLS_TO_ALL = 500_000, 100_000
MISSING = "(none)"
#: Target shares of the forms, and the power that tempers present shares.
FORM_SHARES = {"article": 0.42, "long": 0.5, "table": 0.04, "brief": 0.04}
POWER = 0.8


def token_count(text: Column) -> Column:
    """Blank-separated words of a whole text; 0 for null and empty ones."""
    return F.when(F.length(text) > 0, F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).otherwise(0).cast("long")


def form_topic(text: Column) -> Column:
    """The form of a text, for corpora without topics: table, brief, article or long."""
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    n = token_count(text)
    return F.when(bars * 20 > n, "table").when(n < 100, "brief").when(n < 500, "article").otherwise("long")


def tempered_targets(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """value, share: present token shares raised to ``power`` and scaled to add up to 1."""
    raised = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("tokens")).where("tokens > 0").withColumn("raised", F.pow("tokens", F.lit(power)))
    return raised.select("value", (F.col("raised") / F.sum("raised").over(Window.partitionBy(F.lit(1)))).alias("share"))


def fixed_targets(spark: SparkSession, shares: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(list(shares.items()), "value string, share double")


def present_targets(cells: DataFrame) -> dict[str, DataFrame]:
    """Every marginal's present shares, tempered."""
    return {d: tempered_targets(cells, d, POWER) for d in DIMENSIONS}


def form_targets(cells: DataFrame) -> dict[str, DataFrame]:
    """Tempered sources and languages, and FORM_SHARES for topics by ``form_topic``."""
    return present_targets(cells) | {"topic": fixed_targets(cells.sparkSession, FORM_SHARES)}


def _placed(cells: DataFrame, dimension: str, targets: DataFrame) -> DataFrame:
    """Cells with t_<dimension>, the target of their value, null without one."""
    t = targets.select(F.col("value").alias(dimension), F.col("share").alias(f"t_{dimension}"))
    return cells.join(F.broadcast(t) if targets.count() <= CELLS_TO_ALL else t, dimension, "left")


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """Cells (dimensions, tokens) with ``weight`` and targets t_*, fitted to the target shares of every dimension.

    ``targets`` has a table (value, share) for each dimension to rake. Values without a target
    get weight 0; targets without tokens count for nothing, the others are scaled to add up.
    """
    for d, t in targets.items():
        cells = _placed(cells, d, t)
    have = cells.where(" AND ".join(["tokens > 0", *(f"coalesce(t_{d}, 0) > 0" for d in targets)]))
    for d in targets:  # targets of the values that are present, scaled to add up to 1
        present = materialise(have.groupBy(d).agg(F.first(f"t_{d}").alias("t")), "present")
        scaled = present.select(F.col(d).alias("value"), (F.col("t") / F.sum("t").over(Window.partitionBy(F.lit(1)))).alias("share"))
        have = _placed(have.drop(f"t_{d}"), d, scaled)
    have = have.withColumn("weight", F.col("tokens").cast("double"))
    have = materialise(have, "cells")
    if have.count() <= CELLS_IN_ONE:
        have = have.repartition(1)  # a single partition serves every window below
    for n in range(rounds):
        for d in targets:
            have = have.withColumn("weight", F.col("weight") * F.col(f"t_{d}") / F.sum("weight").over(Window.partitionBy(d)))
        if n % 5 == 4 and n + 1 < rounds:
            have = materialise(have, "raked")
            have = have.repartition(1) if have.count() <= CELLS_IN_ONE else have
    return materialise(have, "fitted")


def deviation(fitted: DataFrame, dimensions: list[str]) -> DataFrame:
    """dimension, deviation: by how much the fitted shares miss the targets at most; 0 is convergence."""
    out = None
    for d in dimensions:
        shares = fitted.groupBy(d).agg(F.sum("weight").alias("w"), F.first(f"t_{d}").alias("t")).withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy(F.lit(1))))
        row = shares.agg(F.max(F.abs(F.col("share") - F.col("t"))).alias("deviation")).select(F.lit(d).alias("dimension"), "deviation")
        out = row if out is None else out.unionByName(row)
    return out


def kept_share(mixed: DataFrame) -> DataFrame:
    """The share of documents and of tokens that a mix keeps in expectation."""
    return mixed.agg(F.avg("mix_probability").alias("documents"), (F.sum(F.col("mix_probability") * F.col("mix_tokens")) / F.sum("mix_tokens")).alias("tokens"))


def mix(docs: DataFrame, topic: Column, targets: dict[str, DataFrame] | Callable[[DataFrame], dict[str, DataFrame]] = present_targets, rounds: int = ROUNDS, seed: str = "mix") -> DataFrame:
    """All rows of ``docs`` with mix_topic, mix_tokens, mix_probability and mix_kept.

    ``targets`` gives the shares of source, lang and topic, or is a function that makes them of the
    cells. Documents of values without a target are dropped. Cells that are scarce for their targets set the scale: their documents are
    kept with probability 1, all others with less (see ``kept_share``). A document is kept if a number drawn from its doc_id lies
    below its cell's probability, so the draw doesn't depend on partitioning, and rows of one
    doc_id fare alike. Null source and lang are a value of their own. Documents without tokens
    carry no weight and are dropped (probability 0). Columns named mix_* are replaced.
    """
    text = F.col("text")
    named = docs.withColumns({"mix_source": F.coalesce("source", F.lit(MISSING)), "mix_lang": F.coalesce("lang", F.lit(MISSING)), "mix_topic": F.coalesce(topic, F.lit(MISSING)), "mix_tokens": token_count(text)})
    cells = named.groupBy(F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic")).agg(F.sum("mix_tokens").alias("tokens"))
    cells = materialise(cells, "cells")
    wanted = targets(cells) if callable(targets) else targets
    fitted = rake(cells, wanted, rounds)
    ratio = fitted.withColumn("ratio", F.col("weight") / F.col("tokens"))
    top = ratio.agg(F.max("ratio").alias("top"))
    scaled = ratio.crossJoin(F.broadcast(top))  # one row
    chance = scaled.select(F.col("source").alias("mix_source"), F.col("lang").alias("mix_lang"), F.col("topic").alias("mix_topic"), (F.col("ratio") / F.col("top")).alias("mix_probability"))
    chance = F.broadcast(chance) if fitted.count() <= CELLS_TO_ALL else chance
    joined = named.join(chance, ["mix_source", "mix_lang", "mix_topic"], "left").withColumn("mix_probability", F.coalesce("mix_probability", F.lit(0.0)))
    drawn = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":" + seed))), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    return joined.withColumn("mix_kept", drawn < F.col("mix_probability")).drop("mix_source", "mix_lang")
