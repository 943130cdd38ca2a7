"""The flight page: lists, tracks, profiles and gate dwell of single flights."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airside.functions import flight as fl
from airside.functions.time import boundaries, local_ts
from airside.operators.keyed import top_per_key
from airside.operators.schedules import flight_headers
from airside.operators.spatial import first_places_within

#: Labels of ground vehicles.
GROUND_LABELS = ["TOWER", "SERVICE_VEHICLE", "GROUND_VEHICLE", "LIGHT_SURFACE_VEHICLE", "UNKNOWN_SURFACE"]


def is_flight(flight: str, hex_code: Column, callsign: Column) -> Column:
    """Whether a point is of a flight, given by callsign or by a six-digit address."""
    code = flight.strip().upper()
    return hex_code == code if re.fullmatch(r"[0-9A-F]{6}", code) else callsign == flight


def flight_list_page(flights: DataFrame, day: str, n: int = 500) -> DataFrame:
    """The flights of a day with most points."""
    rows = flights.where(F.col("service_date") == F.lit(day).cast("date"))
    return rows.orderBy(F.col("points").desc(), "flight_id").limit(n)


def flight_list_enriched(page: DataFrame, schedule: DataFrame, names: DataFrame) -> DataFrame:
    """A page of flights whose blank airline, origin and destination come from the schedule, then the
    airline from the callsign's letters; with a label (ground vehicles by their kind)."""
    headers = flight_headers(page.select("flight_id", F.col("service_date").alias("on_date")), schedule).withColumnRenamed("on_date", "service_date")
    columns = ["airline_name", "origin_airport", "destination_airport", "schedule_flight_number"]
    met = page.join(headers.withColumnsRenamed({c: f"_{c}" for c in columns}), ["flight_id", "service_date"], "left")
    filled = met.withColumns({c: F.coalesce(fl.tidy(F.col(c)), F.col(f"_{c}")) for c in columns}).drop(*[f"_{c}" for c in columns])
    letters = F.regexp_replace(F.upper("flight_id"), "[^A-Z]", "")
    for size in (3, 2):
        dim = F.broadcast(names.select(F.col("code").alias("_code"), F.col("airline_name").alias(f"_n{size}")))  # one row an airline code
        filled = filled.withColumn("_code", F.substring(letters, 1, size)).join(dim, "_code", "left").drop("_code")
    ground = F.col("vehicle_category").isin(GROUND_LABELS)
    filled = filled.withColumn("airline_name", F.coalesce("airline_name", F.when(~ground, F.coalesce("_n3", "_n2")))).drop("_n3", "_n2")
    kind = F.initcap(F.replace("vehicle_category", F.lit("_"), F.lit(" ")))
    way = F.concat("origin_airport", F.lit("→"), "destination_airport")
    return filled.withColumn("label", F.when(ground, F.concat_ws(" | ", "flight_id", kind)).otherwise(F.concat_ws(" | ", "flight_id", "airline_name", way)))


def flight_track(points: DataFrame, flight: str, day: str, tz: str) -> DataFrame:
    """The points of one flight on an airport-local day."""
    own = is_flight(flight, F.col("icao_hex"), F.col("flight")) & (F.to_date(local_ts(F.col("ts"), tz)) == F.lit(day).cast("date"))
    return points.where(own & F.col("lat").isNotNull() & F.col("lon").isNotNull())


def flight_profile(track: DataFrame, tz: str) -> DataFrame:
    """Altitude and speed over airport-local time, where both are known."""
    rows = track.where("altitude_baro IS NOT NULL AND velocity IS NOT NULL")
    return rows.select("event_id", local_ts(F.col("ts"), tz).alias("local_ts"), F.col("altitude_baro").cast("double").alias("altitude"), F.col("velocity").cast("double").alias("speed"))


def flight_gate_dwell(points: DataFrame, gates: DataFrame, radius_m: float = 120) -> DataFrame:
    """For each flight and day of ``points`` (flight_id, service_date) the gate near most of its points; of
    several the smallest, which is why of gates at the same position only that is looked at."""
    near = first_places_within(points, gates, radius_m)
    spans = near.groupBy("flight_id", "service_date", "gate_id").agg(F.count("*").alias("points"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    best = top_per_key(spans, ["flight_id", "service_date"], [F.col("points").desc(), F.col("gate_id").asc()])
    return best.withColumn("dwell_minutes", boundaries("minute", F.col("start_ts"), F.col("end_ts")))


def gate_time_lookup(at_gates: DataFrame, gate_time: DataFrame, flight: str) -> DataFrame:
    """For each day the gate at which any session of the flight stood longest."""
    session = ["icao_hex", "service_date", "session_seq"]
    own = at_gates.where(is_flight(flight, F.col("icao_hex"), F.col("flight"))).select(*session).distinct()
    stays = gate_time.join(own, session, "left_semi")
    best = top_per_key(stays, ["service_date"], [F.col("seconds").desc(), F.col("icao_hex").asc(), F.col("session_seq").asc()])
    return best.select("service_date", "gate_id", F.round(F.col("seconds") / 60).cast("long").alias("dwell_minutes"))


def od_for_flights(flights: DataFrame, ids: list[str]) -> DataFrame:
    return flights.where(F.col("flight_id").isin(ids)).select("service_date", "flight_id", "origin_airport", "destination_airport")


def callsigns_by_category(cells: DataFrame) -> DataFrame:
    """For each cell and category its callsigns in order, from rows (q, r, vehicle_category, flight)."""
    distinct = cells.where("flight IS NOT NULL").select("q", "r", "vehicle_category", "flight").distinct()
    few = top_per_key(distinct, ["q", "r", "vehicle_category"], [F.col("flight").asc()], 15)
    return few.groupBy("q", "r", "vehicle_category").agg(F.array_join(F.sort_array(F.collect_list("flight")), ",").alias("callsigns"))
