"""Ground sessions and airborne legs. All windows share the key (icao_hex, service_date), so
that one shuffle serves them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airside.functions import flight as fl
from airside.functions import geo
from airside.functions.time import boundaries, service_date
from airside.operators.keyed import scope

GAP_MINUTES = 20


def _sessions(df: DataFrame, breaks: Column, name: str) -> DataFrame:
    w = Window.partitionBy(*scope(df), "icao_hex", "service_date").orderBy("ts", "event_id")
    gap = boundaries("minute", F.lag("ts").over(w), F.col("ts"))
    opens = (F.coalesce(gap, F.lit(999999)) > GAP_MINUTES) | breaks
    flagged = df.withColumn("_opens", opens.cast("int"))
    return flagged.withColumn(name, F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def ground_points(points: DataFrame, tz: str | Column) -> DataFrame:
    """Points on the ground with service_date, session_seq and lag_seconds; without time or position they don't count."""
    placed = points.where("ts IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    ground = placed.where(fl.is_ground_gate(F.col("velocity"), F.col("altitude_baro"))).withColumn("service_date", service_date(F.col("ts"), tz))
    w = Window.partitionBy(*scope(points), "icao_hex", "service_date").orderBy("ts", "event_id")
    return _sessions(ground, F.lit(False), "session_seq").withColumn("lag_seconds", boundaries("second", F.lag("ts").over(w), F.col("ts")))


def ground_sessions(points: DataFrame, tz: str | Column) -> DataFrame:
    """Sessions of an aircraft's day: start, end, seconds, minutes, points."""
    found = ground_points(points, tz).groupBy(*scope(points), "icao_hex", "service_date", "session_seq").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("points"))
    key = F.md5(F.concat_ws(":", *scope(points), "icao_hex", F.col("service_date").cast("string"), F.col("session_seq").cast("string")))
    found = found.withColumn("dwell_seconds", boundaries("second", F.col("start_ts"), F.col("end_ts")))
    return found.withColumn("dwell_minutes", boundaries("minute", F.col("start_ts"), F.col("end_ts"))).withColumn("ground_session_id", key)


def segments(points: DataFrame, tz: str | Column) -> DataFrame:
    """Points with service_date, is_ground and segment: a new one after a gap or a change of ground state."""
    w = Window.partitionBy(*scope(points), "icao_hex", "service_date").orderBy("ts", "event_id")
    rows = points.withColumn("service_date", service_date(F.col("ts"), tz)).withColumn("is_ground", fl.is_ground_leg(F.col("velocity"), F.col("altitude_baro")))
    before = F.lag("is_ground").over(w)
    return _sessions(rows, F.coalesce(before != F.col("is_ground"), F.lit(False)), "segment")


def flight_legs(points: DataFrame, tz: str | Column, ring: Column | DataFrame, near_m: float = 5000) -> DataFrame:
    """Airborne segments with first and last position and direction relative to the airport.

    ``ring`` is the airport's, or a table (airport_code, ring) for points of several airports.
    """
    first, last = F.struct("ts", "event_id"), F.struct("ts", "event_id")
    legs = segments(points, tz).where(~F.col("is_ground")).groupBy(*scope(points), "icao_hex", "service_date", "segment").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.max("registration").alias("registration"), F.max(F.upper(fl.tidy(F.col("flight")))).alias("callsign"), F.count("*").alias("points"),
        F.min_by(F.struct("lat", "lon"), first).alias("a"), F.max_by(F.struct("lat", "lon"), last).alias("z"),
    )
    if isinstance(ring, DataFrame):
        legs, ring = legs.join(F.broadcast(ring.select("airport_code", F.col("ring").alias("_ring"))), "airport_code"), F.col("_ring")  # a row for each airport
    # One array of both answers: two conditions would be worked out again at each mention.
    near = F.transform(F.array("a", "z"), lambda p: geo.distance_to_polygon_m(p["lat"], p["lon"], ring) <= near_m)
    direction = F.element_at(F.create_map(*[F.lit(x) for x in ("11", "local", "10", "departure", "01", "arrival", "00", "unknown")]), F.array_join(F.transform(near, lambda n: F.when(n, "1").otherwise("0")), ""))
    return legs.withColumn("direction", direction).select(*scope(points), "icao_hex", "service_date", "segment", "start_ts", "end_ts", "registration", "callsign", "points", "direction")
