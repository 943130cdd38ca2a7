"""From raw positions to the canonical table: tidy, key, newest copy, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airside.functions import flight as fl
from airside.operators.keyed import top_per_key, upsert_newest

KEY = ["icao_hex", "ts"]


def normalise(raw: DataFrame) -> DataFrame:
    """Raw rows with upper-case address, tidy upper-case callsign and the flight's key; no address or time, no row."""
    rows = raw.withColumn("icao_hex", F.upper(fl.tidy(F.col("icao_hex")))).withColumn("flight", F.upper(fl.tidy(F.col("flight"))))
    rows = rows.where("icao_hex IS NOT NULL AND ts IS NOT NULL")
    return rows.withColumn("flight_key", fl.flight_key(F.col("icao_hex"), F.col("flight"), F.col("ts")))


def etl_upsert(target: DataFrame, raw: DataFrame) -> DataFrame:
    """The table after a raw batch: of its copies the one ingested last; new keys are added, and
    ``flight_key`` is set on known rows that lack it. Running it twice changes nothing."""
    return upsert_newest(target, normalise(raw), KEY, [F.col("ingested_at").desc(), F.col("event_id").desc()], ["flight_key"])


def dedup_recent(points: DataFrame, as_of: str, days: int, newest: Column) -> DataFrame:
    """One row for each address and time of the last days; older rows stay as they are."""
    bound = F.timestamp_add("DAY", F.lit(-days), F.lit(as_of).cast("timestamp_ntz"))
    recent = top_per_key(points.where(F.col("ts") >= bound), KEY, [newest])
    return recent.unionByName(points.where(F.col("ts") < bound))
