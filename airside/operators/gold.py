"""Derived tables for gates, traffic and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airside.functions import flight as fl
from airside.functions.time import boundaries, service_date
from airside.operators.cover import near_ring
from airside.operators.keyed import scope, top_per_key
from airside.operators.sessions import ground_points
from airside.operators.spatial import nearest_place

GATE_RADIUS_M = 120


def gate_points(points: DataFrame, gates: DataFrame, tz: str | Column) -> DataFrame:
    """Ground points with session, lag and nearest gate."""
    return nearest_place(ground_points(points, tz), [*scope(points), "event_id"], gates, GATE_RADIUS_M)


def flight_gate_time(at_gates: DataFrame) -> DataFrame:
    """The gate at which each session spent most of its time."""
    spent = at_gates.where("gate_id IS NOT NULL").groupBy(*scope(at_gates), "icao_hex", "service_date", "session_seq", "gate_id").agg(F.sum(F.coalesce("lag_seconds", F.lit(0))).alias("seconds"), F.count("*").alias("points"), F.max(fl.tidy(F.col("flight"))).alias("flight"))
    return top_per_key(spent, [*scope(at_gates), "icao_hex", "service_date", "session_seq"], [F.col("seconds").desc(), F.col("points").desc(), F.col("gate_id").asc()])


def gate_util_daily(at_gates: DataFrame) -> DataFrame:
    label = fl.vehicle_category(F.col("category"), F.col("type"))
    return at_gates.where("gate_id IS NOT NULL").groupBy(*scope(at_gates), "service_date", "gate_id", label.alias("vehicle_category")).agg(F.round(F.sum(F.coalesce("lag_seconds", F.lit(0))) / 60, 2).alias("dwell_minutes"), F.count_distinct("icao_hex", "session_seq").alias("sessions"))


def gate_airline_dwell_daily(at_gates: DataFrame, local: DataFrame) -> DataFrame:
    """Dwell by gate and airline code: the matched airline's ICAO, else IATA code, else UNK; ground vehicles under their label."""
    label = fl.vehicle_category(F.col("category"), F.col("type"))
    matched = local.select("event_id", fl.tidy(F.col("airline_icao")).alias("m_icao"), fl.tidy(F.col("airline_iata")).alias("m_iata"))
    named = at_gates.where("gate_id IS NOT NULL").withColumn("label", label).join(matched, "event_id", "left")
    code = F.when(F.col("label").isin(fl.AIRCRAFT_LABELS), F.coalesce("m_icao", "m_iata", F.lit("UNK"))).otherwise(F.col("label"))
    return named.groupBy("service_date", "gate_id", code.alias("airline_code")).agg(F.sum(F.coalesce("lag_seconds", F.lit(0))).alias("dwell_seconds"), F.count_distinct("icao_hex", "session_seq").alias("sessions"))


def traffic_daily(points: DataFrame, tz: str | Column) -> DataFrame:
    label = fl.vehicle_category(F.col("category"), F.col("type"))
    return points.groupBy(*scope(points), service_date(F.col("ts"), tz).alias("service_date"), label.alias("vehicle_category")).agg(F.count_distinct("icao_hex").alias("aircraft"), F.count_distinct(fl.tidy(F.col("flight"))).alias("flights"), F.count("*").alias("records"), F.round(F.avg("altitude_baro"), 3).alias("avg_altitude"), F.round(F.avg("velocity"), 3).alias("avg_speed"))


def traffic_hourly(points: DataFrame) -> DataFrame:
    return points.groupBy(*scope(points), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count_distinct("icao_hex").alias("aircraft"), F.count("*").alias("records"))


#: Sketches of 2**SKETCH_BITS registers: a standard error of 0.8 %, exact up to some hundred aircraft.
SKETCH_BITS = 14


def traffic_sketches(points: DataFrame) -> DataFrame:
    """hour, records, aircraft_sketch: what can be merged to days and ranges without the points."""
    return points.groupBy(*scope(points), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("records"), F.hll_sketch_agg("icao_hex", F.lit(SKETCH_BITS)).alias("aircraft_sketch"))


def flight_list(local: DataFrame, ring: Column, near_m: float = 5000) -> DataFrame:
    """A header for each flight-day of the airport's own points (see ``adsb_local``).

    Attributes come from one point: of local origin or destination first, then of most
    confidence, with an airline, with both ends, the latest. ``touched``: on the ground within
    ``near_m`` of the airport. Kept are flights that touched, or that start or end here.
    """
    local = near_ring(local, ring, near_m, "_near")
    ends = F.col("origin_airport").isNotNull() & F.col("destination_airport").isNotNull()
    order = F.struct("is_local_od", F.coalesce("match_confidence", F.lit(-1)), F.col("airline_name").isNotNull(), ends, "ts", "event_id")
    header = F.struct("icao_hex", "registration", "vehicle_category", "airline_name", "origin_airport", "destination_airport", "schedule_flight_number")
    found = local.groupBy("service_date", "flight_id").agg(
        F.count("*").alias("points"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max_by(header, order).alias("h"), F.bool_or("is_local_od").alias("is_local_od"),
        F.bool_or(fl.is_ground_leg(F.col("velocity"), F.col("altitude_baro")) & F.col("_near")).alias("touched"),
    )
    return found.where("is_local_od OR touched").select("service_date", "flight_id", "points", "first_ts", "last_ts", "h.*", "is_local_od", "touched")


def airline_traffic_daily(points: DataFrame, tz: str | Column) -> DataFrame:
    rows = points.withColumn("label", fl.vehicle_category(F.col("category"), F.col("type"))).where(F.col("label").isin(fl.AIRCRAFT_LABELS) & fl.tidy(F.col("flight")).isNotNull())
    return rows.groupBy(*scope(points), service_date(F.col("ts"), tz).alias("service_date"), F.upper(F.substring(F.trim("flight"), 1, 3)).alias("airline")).agg(F.count_distinct("flight").alias("flights"), F.count_distinct("icao_hex").alias("aircraft"), F.count("*").alias("records"))


def first_departures(schedule: DataFrame, legs: DataFrame) -> DataFrame:
    """schedule_key, seen_ts: the first departing leg of the day with the flight's number and either airline code."""
    gone = legs.where("direction = 'departure'").select(F.col("service_date").alias("flight_date"), fl.callsign_number(F.col("callsign")).alias("flight_number"), fl.callsign_prefix(F.col("callsign")).alias("code"), "start_ts")
    first = gone.where("flight_number IS NOT NULL AND code IS NOT NULL").groupBy("flight_date", "flight_number", "code").agg(F.min("start_ts").alias("seen_ts"))
    codes = F.explode(F.array_distinct(F.array_compact(F.array("airline_icao", "airline_iata"))))
    coded = schedule.select("schedule_key", "flight_date", "flight_number", codes.alias("code"))
    return coded.join(first, ["flight_date", "flight_number", "code"]).groupBy("schedule_key").agg(F.min("seen_ts").alias("seen_ts"))


def airline_delay_daily(schedule: DataFrame, legs: DataFrame, airport: str, late: int = 15, since: str | None = None) -> DataFrame:
    """Departures of the airport (from day ``since`` on) by day and airline: minutes and flights late and early.

    The actual time counts, else the start of the first departing leg with the flight's number
    and either of its airline's codes. Flights without any time are left out.
    """
    own = schedule.where(F.col("dep_airport") == airport)
    own = own if since is None else own.where(F.col("flight_date") >= F.lit(since).cast("date"))
    one = top_per_key(own, ["flight_date", "flight_number", "airline_iata", "airline_icao"], [F.col("dep_scheduled").asc(), F.col("schedule_key").asc()])
    seen = first_departures(one, legs)
    delay = boundaries("minute", F.col("dep_scheduled"), F.coalesce("dep_actual", "seen_ts"))
    rows = one.join(seen, "schedule_key", "left").withColumn("delay", delay).where("delay IS NOT NULL")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.abs("delay"))), F.lit(0))
    return rows.groupBy("flight_date", "airline_icao").agg(
        F.count("*").alias("flights"), total(F.col("delay") > late).alias("delay_minutes"), F.count_if(F.col("delay") > late).alias("delayed"),
        total(F.col("delay") < -late).alias("early_minutes"), F.count_if(F.col("delay") < -late).alias("early"),
    )
