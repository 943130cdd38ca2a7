"""Top rows, upserts and fills by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scope(df: DataFrame) -> list[str]:
    """The airport's key column, where rows of several airports go together."""
    return ["airport_code"] if "airport_code" in df.columns else []


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; Spark cuts to ``n`` before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def upsert_newest(target: DataFrame, batch: DataFrame, keys: list[str], order: list[Column], fill: list[str] | None = None) -> DataFrame:
    """Target rows, with columns ``fill`` set from the batch's newest row where they are null,
    and the batch's new keys. Running it twice changes nothing."""
    fill = fill or []
    newest = top_per_key(batch, keys, order)
    known = target.join(newest.select(*keys, *[F.col(c).alias(f"_{c}") for c in fill]), keys, "left")
    known = known.select(*[F.coalesce(c, f"_{c}").alias(c) if c in fill else F.col(c) for c in target.columns])
    return known.unionByName(newest.join(target.select(*keys), keys, "left_anti").select(*target.columns))


def merge_coalesce(target: DataFrame, batch: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """Full outer join in which the batch's values win where they aren't null.

    Of several batch rows of one key the newest counts, whole: the greatest by ``order``, then by
    all other columns. Null keys meet.
    """
    others = [c for c in target.columns if c != key]
    first = [c for c in order or [] if c in others]
    row = F.max(F.struct(*first, *[c for c in others if c not in first]))
    one = batch.groupBy(key).agg(row.alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in others])
    t, b = target.alias("t"), one.alias("b")
    joined = t.join(b, F.col(f"t.{key}").eqNullSafe(F.col(f"b.{key}")), "full")
    return joined.select(*[F.coalesce(f"b.{c}", f"t.{c}").alias(c) for c in target.columns])


def fill_from_neighbours(df: DataFrame, keys: list[str], order: str, column: str) -> DataFrame:
    """previous_/next_ columns: the nearest non-null value before and after each row."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(column, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return df.withColumn(f"previous_{column}", before).withColumn(f"next_{column}", after)
