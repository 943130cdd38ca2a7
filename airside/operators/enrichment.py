"""Points with their flight's schedule, the airport's own flights, dwell with airline, timetable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airside.functions import flight as fl
from airside.functions.time import boundaries
from airside.operators.cover import near_ring
from airside.operators.keyed import top_per_key
from airside.operators.schedules import schedule_for_flight
from airside.operators.sessions import segments
from airside.operators.spatial import nearest_place

LEG = ["icao_hex", "service_date", "segment"]
PROPAGATED, PROPAGATED_CONFIDENCE = "propagated", 50


def anchors(legs: DataFrame, results: DataFrame) -> DataFrame:
    """Matched legs with the time that stands for each: start, end or middle, by direction."""
    middle = F.timestamp_add("SECOND", F.floor(boundaries("second", F.col("start_ts"), F.col("end_ts")) / 2).cast("int"), F.col("start_ts"))
    at = F.when(F.col("direction") == "departure", F.col("start_ts")).when(F.col("direction") == "arrival", F.col("end_ts")).otherwise(middle)
    return legs.withColumn("anchor_ts", at).join(results.select(*LEG, "schedule_key", "method", "confidence"), LEG).select(*LEG, "schedule_key", "method", "confidence", "anchor_ts")


def nearest_anchor(points: DataFrame, found: DataFrame) -> DataFrame:
    """Points with ``own_key`` of their leg, the keys of the matched legs before and after, and
    ``schedule_key``: their own, else that of the leg whose anchor is nearer in time (the earlier of two)."""
    met = points.join(found.withColumnRenamed("schedule_key", "own_key"), LEG, "left")
    w = Window.partitionBy("icao_hex", "service_date").orderBy("ts", "event_id")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    here = F.when(F.col("own_key").isNotNull(), F.struct(F.col("own_key").alias("key"), F.col("anchor_ts").alias("at")))
    filled = met.withColumn("_here", here).withColumn("_before", F.last("_here", ignorenulls=True).over(back)).withColumn("_after", F.first("_here", ignorenulls=True).over(ahead))
    minutes = lambda side: F.abs(boundaries("minute", F.col(f"{side}.at"), F.col("ts")))
    nearer = F.when(F.col("_before").isNull(), F.col("_after.key")).when(F.col("_after").isNull(), F.col("_before.key")).when(minutes("_before") <= minutes("_after"), F.col("_before.key")).otherwise(F.col("_after.key"))
    keyed = filled.withColumns({"schedule_key": F.coalesce("own_key", nearer), "prev_key": F.col("_before.key"), "next_key": F.col("_after.key")})
    return keyed.drop("_here", "_before", "_after")


def airline_dims(airlines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The airline dimension by ICAO and by IATA code, one row a code."""

    def one(code: str, other: str) -> DataFrame:
        rows = airlines.select(F.upper(F.trim(code)).alias(code), fl.tidy(F.col(other)).alias(other), fl.tidy(F.col("airline_name")).alias("airline_name"))
        return rows.where(F.length(code) > 0).groupBy(code).agg(F.max(other).alias(other), F.max("airline_name").alias("airline_name"))

    return one("airline_icao", "airline_iata"), one("airline_iata", "airline_icao")


def _with_dims(rows: DataFrame, callsign: Column, airlines: DataFrame) -> DataFrame:
    """Adds d3_* and d2_*: the airline of the first three and of the first two letters."""
    icao, iata = airline_dims(airlines)
    code = F.upper(F.trim(callsign))
    rows = rows.withColumn("_p3", F.regexp_substr(code, F.lit("^[A-Z]{3}"))).withColumn("_p2", F.regexp_substr(code, F.lit("^[A-Z]{2}")))
    rows = rows.join(icao.select(F.col("airline_icao").alias("_p3"), F.col("airline_icao").alias("d3_icao"), F.col("airline_name").alias("d3_name")), "_p3", "left")
    rows = rows.join(iata.select(F.col("airline_iata").alias("_p2"), F.col("airline_iata").alias("d2_iata"), F.col("airline_name").alias("d2_name")), "_p2", "left")
    return rows


def enrich_points(points: DataFrame, legs: DataFrame, results: DataFrame, schedule: DataFrame, prior: DataFrame, airlines: DataFrame, tz: str, codes: list[str]) -> DataFrame:
    """Every point with the schedule row of its leg, else of the nearer matched leg before or after.

    Airline, origin and destination come from that row, else from the callsign's history, else
    (the airline) from the callsign's first letters. One shuffle by aircraft and day serves the
    segments, the join with the legs and the fills.
    """
    rows = segments(points, tz).withColumn("vehicle_category", fl.vehicle_category(F.col("category"), F.col("type")))
    keyed = nearest_anchor(rows, anchors(legs, results)).drop("prev_key", "next_key", "anchor_ts")
    flights = top_per_key(schedule, ["schedule_key"], [F.col("updated_at").desc(), F.col("flight_iata").asc_nulls_last()])
    known = flights.select(
        "schedule_key", F.col("flight_number").alias("s_number"), F.col("airline_name").alias("s_name"), F.col("airline_iata").alias("s_iata"), F.col("airline_icao").alias("s_icao"),
        F.col("dep_airport").alias("s_from"), F.col("arr_airport").alias("s_to"), F.col("dep_scheduled").alias("scheduled_departure"), F.col("arr_scheduled").alias("scheduled_arrival"),
    )
    history = prior.select("callsign_key", F.col("airline_name").alias("r_name"), F.col("airline_iata").alias("r_iata"), F.col("airline_icao").alias("r_icao"), F.col("origin_airport").alias("r_from"), F.col("destination_airport").alias("r_to"))
    full = keyed.join(known, "schedule_key", "left").withColumn("callsign_key", fl.callsign_key(F.col("flight"))).join(history, "callsign_key", "left")
    full = _with_dims(full, F.col("flight"), airlines)
    own = F.coalesce(F.upper(F.trim("s_from")).isin(codes) | F.upper(F.trim("s_to")).isin(codes), F.lit(False))
    return full.select(
        *[c for c in points.columns if c != "schedule_key"], "service_date", "segment", "vehicle_category", "schedule_key",
        F.coalesce(F.when(F.col("own_key").isNotNull(), F.col("s_number")), fl.tidy(F.col("flight"))).alias("schedule_flight_number"),
        F.coalesce("method", F.lit(PROPAGATED)).alias("match_method"), F.coalesce("confidence", F.lit(PROPAGATED_CONFIDENCE)).alias("match_confidence"),
        F.coalesce("s_name", "r_name", "d3_name", "d2_name").alias("airline_name"), F.coalesce("s_iata", "r_iata", "d2_iata").alias("airline_iata"),
        F.coalesce("s_icao", "r_icao", "d3_icao").alias("airline_icao"), F.coalesce("s_from", "r_from").alias("origin_airport"),
        F.coalesce("s_to", "r_to").alias("destination_airport"), "scheduled_departure", "scheduled_arrival", own.alias("is_local_od"),
    )


def adsb_local(enriched: DataFrame, ring: Column, near_m: float = 5000) -> DataFrame:
    """Whole flight-days that start or end at the airport or come near it, airlines of aircraft only."""
    rows = enriched.withColumn("flight_id", fl.flight_id(F.col("flight"), F.col("icao_hex")))
    relevant = near_ring(rows.select("service_date", "flight_id", "is_local_od", "lat", "lon"), ring, near_m, "near").where("is_local_od OR near").select("service_date", "flight_id").distinct()
    kept = rows.join(relevant, ["service_date", "flight_id"], "left_semi")
    return kept.withColumns({c: fl.aircraft_only(F.col("vehicle_category"), F.col(c)) for c in ("airline_name", "airline_iata", "airline_icao")})


def flight_dwell_with_airline(at_gates: DataFrame, gate_time: DataFrame, local: DataFrame, airlines: DataFrame) -> DataFrame:
    """Each session's whole dwell at gates, its main gate and its airline as far as any source names it."""
    session = ["icao_hex", "service_date", "session_seq"]
    label = fl.vehicle_category(F.col("category"), F.col("type"))
    spent = at_gates.where("gate_id IS NOT NULL").groupBy(*session).agg(F.max(label).alias("vehicle_category"), F.sum(F.coalesce("lag_seconds", F.lit(0))).alias("seconds"))
    main = gate_time.select(*session, "gate_id", "flight")
    known = local.groupBy("icao_hex", "service_date").agg(*[F.max(fl.tidy(F.col(c))).alias(c) for c in ("airline_icao", "airline_iata", "airline_name")])
    met = _with_dims(spent.join(main, session, "left").join(known, ["icao_hex", "service_date"], "left"), F.col("flight"), airlines)
    return met.select(
        F.coalesce("flight", "icao_hex").alias("flight_number"), F.coalesce("airline_icao", "airline_iata", "d3_icao", "d2_iata", "_p3", "_p2", F.lit("UNK")).alias("airline_code"),
        F.coalesce("airline_name", "d3_name", "d2_name").alias("airline_name"), *session, "gate_id", F.round(F.col("seconds") / 60).cast("long").alias("dwell_minutes"), "vehicle_category",
    )


def live_timetable(local: DataFrame, schedule: DataFrame, gates: DataFrame, gate_time: DataFrame, airlines: DataFrame, as_of: str, codes: list[str], minutes: int = 10) -> DataFrame:
    """The latest point of each callsign of the last minutes with schedule, planned, nearest and actual gate."""
    now = F.lit(as_of).cast("timestamp_ntz")
    recent = local.where((F.col("ts") <= now) & (F.col("ts") >= F.timestamp_add("MINUTE", F.lit(-minutes), now)) & fl.tidy(F.col("flight")).isNotNull())
    latest = top_per_key(recent, ["flight"], [F.col("ts").desc(), F.col("event_id").desc()])
    latest = latest.select("event_id", "flight", "icao_hex", "registration", F.col("ts").alias("last_seen"), "lat", "lon", "altitude_baro", "velocity", F.to_date(now).alias("on_date"))
    near = nearest_place(latest, "event_id", gates, 300).withColumnsRenamed({"gate_id": "nearest_gate", "gate_m": "nearest_gate_m"})
    best = schedule_for_flight(latest.withColumn("flight_id", F.col("flight")), schedule).withColumn("direction", fl.schedule_direction(F.upper("dep_airport"), F.upper("arr_airport"), codes))
    plan = best.select(F.col("flight_id").alias("flight"), "schedule_key", "direction", "dep_airport", "arr_airport", "dep_scheduled", "arr_scheduled", "flight_status",
                       fl.planned(F.col("direction"), F.col("dep_gate"), F.col("arr_gate")).alias("planned_gate"), fl.planned(F.col("direction"), F.col("dep_terminal"), F.col("arr_terminal")).alias("planned_terminal"),
                       F.col("airline_name").alias("s_name"))
    stays = top_per_key(gate_time.where("flight IS NOT NULL"), ["flight"], [F.col("service_date").desc(), F.col("seconds").desc(), F.col("icao_hex").asc(), F.col("session_seq").asc()])
    stays = stays.select("flight", F.col("gate_id").alias("actual_gate"), F.col("seconds").alias("actual_gate_seconds"))
    full = _with_dims(near.join(plan, "flight", "left").join(stays, "flight", "left"), F.col("flight"), airlines)
    return full.select(
        "flight", "icao_hex", "registration", "last_seen", "lat", "lon", "altitude_baro", "velocity", "direction", F.coalesce("s_name", "d3_name", "d2_name").alias("airline_name"), "schedule_key",
        "dep_airport", "arr_airport", "dep_scheduled", "arr_scheduled", "flight_status", "planned_gate", "planned_terminal", "nearest_gate", F.round("nearest_gate_m", 1).alias("nearest_gate_m"), "actual_gate", "actual_gate_seconds",
    )
