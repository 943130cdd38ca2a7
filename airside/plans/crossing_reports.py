"""Reports on runway crossings: events with their flight, and aggregations of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airside.functions import flight as fl
from airside.functions import geo
from airside.functions.time import day_of_week, local_ts, service_date
from airside.operators.keyed import top_per_key

DIRECTIONS = ["S→N", "N→S"]


def flights_of(points: DataFrame) -> DataFrame:
    """flight_key, icao_hex, service_date, flight_number (the first callsign), airline_code of keyed points."""
    first = F.min_by("flight", F.when(F.col("flight").isNotNull(), F.struct("ts", "event_id")))
    found = points.groupBy("flight_key", "icao_hex", "service_date").agg(first.alias("flight_number"))
    return found.withColumn("airline_code", F.coalesce(F.regexp_substr("flight_number", F.lit("^[A-Z]{3}")), F.lit("UNK")))


def crossing_events(crossings: DataFrame, flights: DataFrame) -> DataFrame:
    return crossings.join(flights, "flight_key")


def _minutes(seconds: Column, digits: int = 2) -> Column:
    return F.round(seconds / 60, digits)


def crossing_summary(events: DataFrame, divisor: Column) -> DataFrame:
    return events.agg(
        F.round(F.count_distinct("flight_key") / divisor).alias("total_flights"), F.round(F.count("*") / divisor).alias("total_crossings"),
        F.round(F.avg("seconds"), 3).alias("avg_duration_s"), F.round(F.sum("seconds") / 60 / divisor).alias("total_duration_min"),
    )


def crossing_cells(events: DataFrame, degrees: float, metric: str) -> DataFrame:
    """Flights and minutes by hexagon of the crossing's midpoint, where the chosen metric isn't 0."""
    q, r = geo.hex_cell(F.col("midpoint.lat"), F.col("midpoint.lon"), degrees)
    by = events.withColumn("q", q).withColumn("r", r).groupBy("q", "r")
    first = F.struct("t_entry", "flight_key", "runway_id", "event")
    cells = by.agg(F.count_distinct("flight_key").alias("flights"), _minutes(F.sum("seconds"), 1).alias("minutes"), F.round(F.min_by("midpoint.lat", first), 6).alias("lat"), F.round(F.min_by("midpoint.lon", first), 6).alias("lon"))
    return cells.where(F.col(metric) > 0)


def crossing_details(events: DataFrame, n: int = 100) -> DataFrame:
    latest = events.orderBy(F.col("t_entry").desc(), "flight_key", "runway_id", "event").limit(n)
    return latest.select("flight_key", "runway_id", "t_entry", "t_exit", "direction", "seconds", _minutes(F.col("seconds")).alias("minutes"), F.round("max_speed", 1).alias("max_speed"), "chord_m", "flight_number", "airline_code")


def dominant_direction(events: DataFrame) -> DataFrame:
    """The direction in which a flight crossed most often on a day."""
    counted = events.groupBy("flight_key", "service_date", "direction").agg(F.count("*").alias("crossings"))
    return top_per_key(counted, ["flight_key", "service_date"], [F.col("crossings").desc(), F.col("direction").asc()])


def crossing_paths(events: DataFrame, points: DataFrame, schedule: DataFrame) -> DataFrame:
    """Points of the flights that crossed, with the direction and, by day and number, origin and destination."""
    way = dominant_direction(events).drop("crossings").withColumnRenamed("service_date", "crossing_date")
    paths = points.join(way, "flight_key").withColumn("number", F.regexp_substr("flight", F.lit("[0-9]+")))
    od = top_per_key(schedule, ["flight_date", "flight_number"], [F.col("updated_at").desc(), F.col("schedule_key").asc()])
    od = od.select(F.col("flight_date").alias("crossing_date"), F.col("flight_number").alias("number"), F.col("dep_airport").alias("origin_airport"), F.col("arr_airport").alias("destination_airport"))
    return paths.join(od, ["crossing_date", "number"], "left").select("flight_key", "event_id", "crossing_date", "direction", "origin_airport", "destination_airport")


def crossing_dow_hour(events: DataFrame, tz: str) -> DataFrame:
    at = local_ts(F.col("t_entry"), tz)
    return events.groupBy(day_of_week(at).alias("dow"), F.hour(at).alias("hour")).agg(F.count("*").alias("crossings"))


def crossing_by(events: DataFrame, key: str) -> DataFrame:
    """Crossings, minutes and mean seconds by direction, airline, flight or type of flight."""
    by = events.groupBy(key).agg(F.count("*").alias("crossings"), F.sum("seconds").alias("seconds"), F.round(F.avg("seconds"), 1).alias("avg_seconds"))
    return by.withColumn("minutes", _minutes(F.col("seconds")))


def flight_types(legs: DataFrame) -> DataFrame:
    """icao_hex, service_date, flight_type: the direction of most legs of that day (ties by name)."""
    counted = legs.where("direction <> 'unknown'").groupBy("icao_hex", "service_date", "direction").agg(F.count("*").alias("n"))
    best = top_per_key(counted, ["icao_hex", "service_date"], [F.col("n").desc(), F.col("direction").asc()])
    return best.select("icao_hex", "service_date", F.initcap("direction").alias("flight_type"))


def crossing_by_flight_type(events: DataFrame, legs: DataFrame) -> DataFrame:
    typed = events.join(flight_types(legs), ["icao_hex", "service_date"], "left").withColumn("flight_type", F.coalesce("flight_type", F.lit("Unknown")))
    return crossing_by(typed, "flight_type").drop("avg_seconds")


def crossing_gate_join(events: DataFrame, gate_time: DataFrame) -> DataFrame:
    """Crossings with the gates of the same aircraft, day and flight."""
    at = gate_time.where("flight IS NOT NULL").select("icao_hex", "service_date", F.col("flight").alias("flight_number"), "session_seq", "gate_id")
    return events.join(at, ["icao_hex", "service_date", "flight_number"])


def crossing_by_gate(joined: DataFrame, n: int = 15) -> DataFrame:
    """gate_id, direction, crossings of the ``n`` gates with most: a pivot by direction, then one row each."""
    wide = joined.groupBy("gate_id").pivot("direction", DIRECTIONS).agg(F.count(F.lit(1))).na.fill(0)
    total = F.col(DIRECTIONS[0]) + F.col(DIRECTIONS[1])
    top = wide.orderBy(total.desc(), "gate_id").limit(n)
    return top.unpivot(["gate_id"], DIRECTIONS, "direction", "crossings")


def gate_for_flight_keys(at_gates: DataFrame, keys: DataFrame) -> DataFrame:
    """The gate at which each of the flights (flight_key) stood longest."""
    keyed = at_gates.where("gate_id IS NOT NULL").withColumn("flight_key", fl.aircraft_day_id(F.col("icao_hex"), F.col("service_date")))
    spent = keyed.join(keys, "flight_key", "left_semi").groupBy("flight_key", "gate_id").agg(F.sum(F.coalesce("lag_seconds", F.lit(0))).alias("seconds"))
    return top_per_key(spent, ["flight_key"], [F.col("seconds").desc(), F.col("gate_id").asc()])


def keyed_points(points: DataFrame, tz: str) -> DataFrame:
    """Points with service_date and flight_key (aircraft and day)."""
    dated = points.withColumn("service_date", service_date(F.col("ts"), tz))
    return dated.withColumn("flight_key", fl.aircraft_day_id(F.col("icao_hex"), F.col("service_date")))


def flight_sample(points: DataFrame, n: int, seed: str) -> DataFrame:
    """Points of at most ``n`` flights, drawn by a hash of their keys: the same on every run."""
    chosen = points.select("flight_key").distinct().orderBy(F.md5(F.concat(F.lit(seed), "flight_key"))).limit(n)
    return points.join(F.broadcast(chosen), "flight_key", "left_semi")

