"""The aircraft dimension: whom to look up, merging what was found, filling points from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airside.functions import flight as fl
from airside.operators.keyed import merge_coalesce

#: Some hundred bytes each: up to so many rows are broadcast.
BROADCAST_AIRCRAFT = 100_000


def meta_candidates(points: DataFrame, meta: DataFrame, as_of: str, seen_hours: int, fresh_hours: int, most: int = 200) -> DataFrame:
    """Aircraft seen of late whose type or description is unknown and wasn't looked up just now."""
    now = F.lit(as_of).cast("timestamp_ntz")
    seen = points.where(F.col("ts") >= F.timestamp_add("HOUR", F.lit(-seen_hours), now)).select("icao_hex").distinct()
    complete = meta.where("type IS NOT NULL AND aircraft_desc IS NOT NULL")
    fresh = meta.where(F.col("updated_at") >= F.timestamp_add("HOUR", F.lit(-fresh_hours), now))
    return seen.join(complete.select("icao_hex"), "icao_hex", "left_anti").join(fresh.select("icao_hex"), "icao_hex", "left_anti").orderBy("icao_hex").limit(most)


def meta_upsert(meta: DataFrame, found: DataFrame) -> DataFrame:
    """The dimension after a look-up: values found win over those known, new aircraft are added; of
    several finds of one aircraft the newest counts."""
    return merge_coalesce(meta, found, "icao_hex", ["updated_at"])


def desc_backfill(points: DataFrame, meta: DataFrame) -> DataFrame:
    """Points whose blank type, description and registration come from the dimension: of several rows of one
    aircraft from the newest. A dimension of at most BROADCAST_AIRCRAFT rows spares the points a shuffle."""
    columns = ["type", "aircraft_desc", "registration"]
    newest = F.max(F.struct(*(["updated_at"] if "updated_at" in meta.columns else []), *columns)).alias("m")
    known = meta.groupBy("icao_hex").agg(newest).select("icao_hex", *[F.col(f"m.{c}").alias(f"_{c}") for c in columns])
    met = points.join(F.broadcast(known) if known.count() <= BROADCAST_AIRCRAFT else known, "icao_hex", "left")
    return met.withColumns({c: F.coalesce(fl.tidy(F.col(c)), F.col(f"_{c}")) for c in columns}).drop(*[f"_{c}" for c in columns])
