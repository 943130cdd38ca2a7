"""Queries of the airport operators by name, each with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airside.functions import flight as fl
from airside.functions import geo
from airside.functions.time import local_ts, service_date
from airside.operators import gold, keyed, matching, positions, sessions, spatial
from airside.operators.cover import near_ring
from airside.plans import fixtures as fx
from airside.plans import reports as rp
from airside.plans.fixtures import AIRCRAFT, BASE, LOCAL_DAY, TZ, oracle
from airside.registry import ORACLE_SQL, QUERIES, query
from airside.sources.files import stored

def on_points(name: str, sql: str, build: Callable[[DataFrame], DataFrame], *needs: str) -> None:
    """A query that is one step over the points."""
    query(name, oracle(sql, *(needs or ("points",))))(lambda s, d: build(fx.points(s, d)))


def _legs(s: SparkSession, d: str) -> DataFrame:
    return sessions.flight_legs(fx.points(s, d), TZ, fx.ring())


def _candidates(s: SparkSession, d: str) -> DataFrame:
    return matching.match_candidates(_legs(s, d), fx.schedule(s, d), fx.airlines(s).select("airline_iata", "airline_icao"))


def _each_once(s: SparkSession, d: str, pairs: DataFrame) -> DataFrame:
    """Pairs of legs and schedule rows without copies. A key of one row only leaves none to take out, so that
    the pairs, by far the most rows here, needn't be dealt out anew."""
    keys = fx.schedule(s, d).groupBy("schedule_key").agg(F.count("*").alias("n"))
    return pairs if keys.where("n > 1").isEmpty() else pairs.distinct()


def _best(s: SparkSession, d: str, legs: DataFrame) -> DataFrame:
    return matching.best_matches(legs, fx.schedule(s, d), [fx.AIRPORT], fx.airlines(s).select("airline_iata", "airline_icao"))


def _results(s: SparkSession, d: str) -> DataFrame:
    return _best(s, d, _legs(s, d))


def matched(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Legs and their chosen schedule rows, stored, because several later steps read both."""
    legs = stored(_legs(s, d), "legs")
    return legs, stored(_best(s, d, legs), "results")


def _at_gates(s: SparkSession, d: str) -> DataFrame:
    return gold.gate_points(fx.points(s, d), fx.gates(s, d), TZ)


C = F.col

# --- scalar functions ---------------------------------------------------------------------
on_points("service_date", f"SELECT event_id, {LOCAL_DAY} AS service_date FROM points", lambda p: p.select("event_id", service_date(C("ts"), TZ).alias("service_date")))
on_points("local_ts", f"SELECT event_id, ts AT TIME ZONE 'UTC' AT TIME ZONE '{TZ}' AS local_ts FROM points", lambda p: p.select("event_id", local_ts(C("ts"), TZ).alias("local_ts")))
on_points("flight_id", "SELECT event_id, coalesce(nullif(trim(flight), ''), icao_hex) AS flight_id FROM points", lambda p: p.select("event_id", fl.flight_id(C("flight"), C("icao_hex")).alias("flight_id")))
on_points("is_ground_leg", "SELECT event_id, is_ground FROM flagged", lambda p: p.select("event_id", fl.is_ground_leg(C("velocity"), C("altitude_baro")).alias("is_ground")), "flagged")
on_points("is_ground_gate", "SELECT event_id FROM ground", lambda p: p.where(fl.is_ground_gate(C("velocity"), C("altitude_baro"))).select("event_id"), "ground")
on_points("vehicle_category", "SELECT event_id, vehicle_category FROM labelled", lambda p: p.select("event_id", fl.vehicle_category(C("category"), C("type")).alias("vehicle_category")), "labelled")
on_points("aircraft_only_mask", f"SELECT event_id, CASE WHEN vehicle_category IN {AIRCRAFT} THEN flight END AS flight FROM labelled", lambda p: p.select("event_id", fl.aircraft_only(fl.vehicle_category(C("category"), C("type")), C("flight")).alias("flight")), "labelled")
on_points("vehicle_filter", "SELECT event_id FROM labelled WHERE vehicle_category IN ('HELICOPTER', 'TOWER')", lambda p: p.where(fl.vehicle_filter(fl.vehicle_category(C("category"), C("type")), ["HELICOPTER", "TOWER"])).select("event_id"), "labelled")
on_points("callsign_normalise", f"SELECT event_id, {BASE} AS base, nullif(regexp_extract({BASE}, '^[A-Z]{{2,3}}'), '') AS prefix, nullif(regexp_extract({BASE}, '[0-9]+'), '') AS number FROM points", lambda p: p.select("event_id", fl.callsign_base(C("flight")).alias("base"), fl.callsign_prefix(C("flight")).alias("prefix"), fl.callsign_number(C("flight")).alias("number")))
on_points("callsign_key", "SELECT event_id, nullif(regexp_extract(upper(trim(flight)), '^[A-Z]{2,3}[0-9]+'), '') AS callsign_key FROM points", lambda p: p.select("event_id", fl.callsign_key(C("flight")).alias("callsign_key")))
on_points("flight_key_md5", "SELECT event_id, md5(icao_hex || ':' || coalesce(flight, '') || ':' || strftime(ts, '%Y%m%d%H')) AS flight_key FROM points", lambda p: p.select("event_id", fl.flight_key(C("icao_hex"), C("flight"), C("ts")).alias("flight_key")))
on_points("aircraft_day_id", "SELECT event_id, md5(icao_hex || ':' || CAST(service_date AS VARCHAR)) AS aircraft_day_id FROM labelled", lambda p: p.select("event_id", fl.aircraft_day_id(C("icao_hex"), service_date(C("ts"), TZ)).alias("aircraft_day_id")), "labelled")
on_points("flight_phase", """SELECT event_id, CASE WHEN altitude_baro IS NULL OR velocity IS NULL THEN 'Unknown' WHEN altitude_baro < 1000 THEN CASE WHEN velocity < 50 THEN 'Ground' ELSE 'Takeoff/Landing' END
  WHEN altitude_baro < 10000 THEN CASE WHEN velocity > 200 THEN 'Climbing' ELSE 'Descending' END WHEN velocity < 100 THEN 'Descending' ELSE 'Cruise' END AS phase FROM points""", lambda p: p.select("event_id", fl.flight_phase(C("altitude_baro"), C("velocity")).alias("phase")))  # fmt: skip
on_points("altitude_band", "SELECT event_id, CASE WHEN altitude_baro IS NULL THEN 'unknown' WHEN altitude_baro < 10000 THEN 'low' WHEN altitude_baro < 25000 THEN 'medium' WHEN altitude_baro < 35000 THEN 'high' ELSE 'very_high' END AS band FROM points", lambda p: p.select("event_id", fl.altitude_band(C("altitude_baro")).alias("band")))
on_points("speed_band", "SELECT event_id, CASE WHEN velocity IS NULL THEN 'unknown' WHEN velocity < 200 THEN 'slow' WHEN velocity < 400 THEN 'medium' ELSE 'fast' END AS band FROM points", lambda p: p.select("event_id", fl.speed_band(C("velocity")).alias("band")))
on_points("freshness_status", "SELECT event_id, CASE WHEN m <= 5 THEN 'Fresh' WHEN m <= 30 THEN 'OK' ELSE 'Stale' END AS status, CASE WHEN date_diff('hour', ts, timestamp '2024-01-01 15:00:00') <= 2 THEN 'OK' ELSE 'STALE' END AS table_status FROM (SELECT *, date_diff('minute', ts, timestamp '2024-01-01 15:00:00') AS m FROM points)", lambda p: _fresh(p))
on_points("st_distance_m", "SELECT event_id, round(" + fx.METRES.format(a="p", b="o") + ", 3) AS metres FROM points p, (SELECT 32.0 AS lat, -117.0 AS lon) o", lambda p: p.select("event_id", F.round(geo.distance_m(C("lat"), C("lon"), F.lit(32.0), F.lit(-117.0)), 3).alias("metres")))
on_points("st_dwithin_point", "SELECT event_id FROM points p, (SELECT 32.0 AS lat, -117.0 AS lon) o WHERE " + fx.METRES.format(a="p", b="o") + " <= 5000", lambda p: p.where(geo.distance_m(C("lat"), C("lon"), F.lit(32.0), F.lit(-117.0)) <= 5000).select("event_id"))
on_points("st_dwithin_polygon", "SELECT event_id, sqrt(pow(greatest(0, abs(lat - 32.0) - 0.01), 2) + pow(greatest(0, abs(lon + 117.0) - 0.01) * cos(radians(lat)), 2)) * 6371000.0 * pi() / 180 <= 5000 AS near FROM points", lambda p: near_ring(p, fx.ring(), 5000, "near").select("event_id", "near"))
on_points("st_intersects_point", "SELECT event_id, sqrt(pow(lat - 32.0, 2) + pow(greatest(0, abs(lon + 117.0) - 0.02) * cos(radians(lat)), 2)) * 6371000.0 * pi() / 180 <= 400 AS inside FROM points", lambda p: p.select("event_id", (geo.distance_to_line_m(C("lat"), C("lon"), F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in fx.RUNWAYS[0][1:3]])) <= 400).alias("inside")))

# --- windows, sessions, legs --------------------------------------------------------------
on_points("lag_gap", "SELECT event_id, gap, lag_seconds FROM gapped", lambda p: _gaps(p), "gapped")
on_points("sessionise_gap", "SELECT event_id, session_seq FROM sessions", lambda p: sessions.ground_points(p, TZ).select("event_id", "session_seq"), "sessions")
on_points("ground_sessions", "SELECT icao_hex, service_date, session_seq, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS points, date_diff('second', min(ts), max(ts)) AS dwell_seconds, date_diff('minute', min(ts), max(ts)) AS dwell_minutes, md5(icao_hex || ':' || CAST(service_date AS VARCHAR) || ':' || CAST(session_seq AS VARCHAR)) AS ground_session_id FROM sessions GROUP BY ALL", lambda p: sessions.ground_sessions(p, TZ), "sessions")
on_points("segment_legs", "SELECT event_id, is_ground, segment FROM segmented", lambda p: sessions.segments(p, TZ).select("event_id", "is_ground", "segment"), "segmented")
query("flight_legs", oracle("SELECT * FROM legs", "legs"))(_legs)
on_points("fill_prev_next", "SELECT event_id, last_value(flight IGNORE NULLS) OVER (PARTITION BY icao_hex, service_date ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_flight, first_value(flight IGNORE NULLS) OVER (PARTITION BY icao_hex, service_date ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_flight FROM (SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN flight END AS flight) FROM labelled)", lambda p: keyed.fill_from_neighbours(_sparse(p), ["icao_hex", "service_date"], "event_id", "flight").select("event_id", "previous_flight", "next_flight"), "labelled")
on_points("partition_max_fill", "SELECT event_id, coalesce(flight, max(flight) OVER (PARTITION BY icao_hex, service_date)) AS flight FROM (SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN flight END AS flight) FROM labelled)", lambda p: _sparse(p).select("event_id", F.coalesce("flight", F.max("flight").over(_by("icao_hex", "service_date"))).alias("flight")), "labelled")
on_points("first_attr_per_key", "SELECT icao_hex, arg_min(lat, (ts, event_id)) AS lat, arg_min(lon, (ts, event_id)) AS lon FROM points GROUP BY icao_hex", lambda p: p.groupBy("icao_hex").agg(F.min_by("lat", F.struct("ts", "event_id")).alias("lat"), F.min_by("lon", F.struct("ts", "event_id")).alias("lon")))
on_points(
    "adsb_dedup",
    "SELECT icao_hex, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY icao_hex, ts ORDER BY event_id DESC) AS rn FROM points) WHERE rn = 1 OR ts < timestamp '2024-01-01 05:00:00'",
    lambda p: positions.dedup_recent(p, "2024-01-02 05:00:00", 1, C("event_id").desc()).select("icao_hex", "ts", "event_id"),
)
on_points(
    "adsb_etl_upsert",
    """SELECT coalesce(t.icao_hex, b.icao_hex) AS icao_hex, coalesce(t.ts, b.ts) AS ts, coalesce(t.event_id, b.event_id) AS event_id, CASE WHEN t.ts IS NULL THEN b.flight_key ELSE coalesce(t.flight_key, b.flight_key) END AS flight_key
    FROM (SELECT icao_hex, ts, max(event_id) AS event_id, CASE WHEN max(event_id) % 4 = 0 THEN 'old' END AS flight_key FROM points WHERE event_id % 2 = 0 GROUP BY ALL) t
    FULL JOIN (SELECT icao_hex, ts, event_id, md5(icao_hex || ':' || coalesce(upper(flight), '') || ':' || strftime(ts, '%Y%m%d%H')) AS flight_key FROM points WHERE event_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY icao_hex, ts ORDER BY event_id DESC) = 1) b USING (icao_hex, ts)""",
    lambda p: _upsert(p),
)


def _fresh(p: DataFrame) -> DataFrame:
    from airside.functions.time import boundaries

    age = lambda unit: boundaries(unit, C("ts"), F.lit("2024-01-01 15:00:00").cast("timestamp_ntz"))
    return p.select("event_id", fl.freshness_status(age("minute")).alias("status"), fl.table_freshness(age("hour")).alias("table_status"))


def _sparse(p: DataFrame) -> DataFrame:
    """Points of which two in three lack their callsign."""
    return p.withColumn("service_date", service_date(C("ts"), TZ)).withColumn("flight", F.when(C("event_id") % 3 == 0, C("flight")))


def _by(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def _gaps(p: DataFrame) -> DataFrame:
    from airside.functions.time import boundaries

    w = _by("icao_hex", "service_date").orderBy("ts", "event_id")
    return sessions.ground_points(p, TZ).select("event_id", boundaries("minute", F.lag("ts").over(w), C("ts")).alias("gap"), "lag_seconds")


def _upsert(p: DataFrame) -> DataFrame:
    """Even events are the target, of which half lack their key; two in three of all are a later raw batch."""
    key = F.when(C("event_id") % 4 == 0, "old")
    target = keyed.top_per_key(p.where("event_id % 2 = 0"), ["icao_hex", "ts"], [C("event_id").desc()]).select("icao_hex", "ts", "event_id", key.alias("flight_key"))
    raw = p.where("event_id % 3 <> 0").select(F.lower(F.concat(F.lit(" "), "icao_hex")).alias("icao_hex"), "ts", "event_id", F.concat("flight", F.lit("  ")).alias("flight"), C("event_id").alias("ingested_at"))
    return positions.etl_upsert(target, raw)


# --- spatial and gates ----------------------------------------------------------------------
query("nearest_gate", oracle("SELECT event_id, gate_id, CASE WHEN gate_id IS NOT NULL THEN round(gate_m, 1) END AS gate_m FROM near", "near"))(lambda s, d: _at_gates(s, d).select("event_id", "gate_id", F.round("gate_m", 1).alias("gate_m")))
query("ground_points", oracle("SELECT event_id, icao_hex, service_date, session_seq, lag_seconds, gate_id FROM near", "near"))(lambda s, d: _at_gates(s, d).select("event_id", "icao_hex", "service_date", "session_seq", "lag_seconds", "gate_id"))
query("flight_gate_time", oracle("SELECT * FROM gate_time", "gate_time"))(lambda s, d: gold.flight_gate_time(_at_gates(s, d)))
_UTIL = "SELECT service_date, gate_id, vehicle_category, round(sum(coalesce(lag_seconds, 0)) / 60.0, 2) AS dwell_minutes, count(DISTINCT (icao_hex, session_seq)) AS sessions FROM near WHERE gate_id IS NOT NULL GROUP BY ALL"
query("gate_util_daily", oracle(_UTIL, "near"))(lambda s, d: gold.gate_util_daily(_at_gates(s, d)))
query("gate_fill_rate", oracle(f"SELECT used, gates, round(used * 100 / gates, 1) AS fill_pct FROM (SELECT count(DISTINCT gate_id) AS used FROM ({_UTIL})), (SELECT count(*) AS gates FROM gates)", "near"))(lambda s, d: rp.gate_fill_rate(gold.gate_util_daily(_at_gates(s, d)), fx.gates(s, d)))
query("gate_rankings", oracle(f"SELECT gate_id, round(sum(dwell_minutes), 2) AS dwell_minutes, CAST(sum(sessions) AS BIGINT) AS sessions FROM ({_UTIL}) GROUP BY gate_id ORDER BY sessions DESC, gate_id LIMIT 15", "near"))(lambda s, d: rp.gate_rankings(gold.gate_util_daily(_at_gates(s, d))))

# --- matching ---------------------------------------------------------------------------------
_LEG = "icao_hex, service_date, segment"
query("match_candidates", oracle(f"SELECT DISTINCT {_LEG}, schedule_key, method, gap FROM candidates", "candidates"))(lambda s, d: _each_once(s, d, _candidates(s, d).select("icao_hex", "service_date", "segment", "schedule_key", "method", "gap")))
query("match_score", oracle(f"SELECT DISTINCT {_LEG}, schedule_key, method, direction_ok, day_diff, score FROM scored", "scored"))(lambda s, d: _each_once(s, d, matching.match_score(_candidates(s, d), [fx.AIRPORT]).select("icao_hex", "service_date", "segment", "schedule_key", "method", "direction_ok", "day_diff", "score")))
query("match_result", oracle(f"SELECT {_LEG}, schedule_key, method, direction_ok, score, greatest(score, 0) AS confidence, abs(gap) AS time_gap, day_diff FROM results", "results"))(_results)
query("callsign_prior", oracle("SELECT * FROM prior", "prior"))(lambda s, d: matching.callsign_prior(*matched(s, d), fx.schedule(s, d), 5))
_HIT = f"SELECT service_date, count(*) AS legs, count(r.schedule_key) AS matched, round(count(r.schedule_key) * 100 / count(*), 1) AS match_pct FROM legs LEFT JOIN (SELECT {_LEG}, schedule_key FROM results) r USING ({_LEG}) GROUP BY service_date"
query("match_rate_trend", oracle(_HIT, "results"))(lambda s, d: rp.match_rate_trend(*matched(s, d)))
query("match_method_mix", oracle("SELECT method, count(*) AS legs, round(avg(greatest(score, 0)), 3) AS confidence FROM results GROUP BY method", "results"))(lambda s, d: rp.match_method_mix(_results(s, d)))
query("schedule_direction", oracle("SELECT schedule_key, CASE WHEN dep_airport = 'TST' THEN 'departure' ELSE 'arrival' END AS direction FROM schedule", "schedule"))(lambda s, d: fx.schedule(s, d).select("schedule_key", fl.schedule_direction(C("dep_airport"), C("arr_airport"), [fx.AIRPORT, "KTST"]).alias("direction")))

# --- traffic and reports --------------------------------------------------------------------------
on_points("traffic_daily", "SELECT service_date, vehicle_category, count(DISTINCT icao_hex) AS aircraft, count(DISTINCT flight) AS flights, count(*) AS records, round(avg(altitude_baro), 3) AS avg_altitude, round(avg(velocity), 3) AS avg_speed FROM labelled GROUP BY ALL", lambda p: gold.traffic_daily(p, TZ), "labelled")
on_points("traffic_hourly", "SELECT date_trunc('hour', ts) AS hour, count(DISTINCT icao_hex) AS aircraft, count(*) AS records FROM points GROUP BY ALL", gold.traffic_hourly)
_AIR = f"SELECT service_date, upper(substr(flight, 1, 3)) AS airline, count(DISTINCT flight) AS flights, count(DISTINCT icao_hex) AS aircraft, count(*) AS records FROM labelled WHERE flight IS NOT NULL AND vehicle_category IN {AIRCRAFT} GROUP BY ALL"
on_points("airline_traffic_daily", _AIR, lambda p: gold.airline_traffic_daily(p, TZ), "labelled")
on_points("top_airlines", f"SELECT airline, CAST(sum(flights) AS BIGINT) AS flights, CAST(sum(records) AS BIGINT) AS records FROM ({_AIR}) GROUP BY airline ORDER BY flights DESC, airline LIMIT 15", lambda p: rp.top_airlines(gold.airline_traffic_daily(p, TZ)), "labelled")
on_points("date_bounds", "SELECT min(service_date) AS first_day, max(service_date) AS last_day FROM labelled", lambda p: rp.date_bounds(p, TZ), "labelled")
on_points("live_positions", "SELECT flight_id, ts, lat, lon, velocity, altitude_baro FROM (SELECT *, coalesce(flight, icao_hex) AS flight_id, row_number() OVER (PARTITION BY coalesce(flight, icao_hex) ORDER BY ts DESC, event_id DESC) AS rn FROM points WHERE ts <= timestamp '2024-01-01 14:30:00' AND date_diff('second', ts, timestamp '2024-01-01 14:30:00') <= 3600) WHERE rn = 1 ORDER BY ts DESC, flight_id LIMIT 500", lambda p: rp.live_positions(p, "2024-01-01 14:30:00", 60))
on_points("trajectories", "SELECT service_date, flight_id, count(*) AS points, string_agg(printf('%.4f', lon) || ' ' || printf('%.4f', lat), ',' ORDER BY rn) AS path FROM (SELECT *, coalesce(flight, icao_hex) AS flight_id, row_number() OVER (PARTITION BY service_date, coalesce(flight, icao_hex) ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY service_date, coalesce(flight, icao_hex)) AS n FROM labelled) WHERE rn = 1 OR rn = n OR (rn - 1) % greatest(1, n // 20) = 0 GROUP BY service_date, flight_id", lambda p: rp.trajectories(p, 20, TZ), "labelled")
on_points("track_segments", "SELECT flight_id, event_id, next_id, round(CASE WHEN hi > lo THEN (altitude_baro - lo) / CAST(hi - lo AS DOUBLE) ELSE 0 END, 6) AS altitude_scaled FROM (SELECT *, lead(event_id) OVER (PARTITION BY service_date, flight_id ORDER BY ts, event_id) AS next_id, min(altitude_baro) OVER (PARTITION BY service_date, flight_id) AS lo, max(altitude_baro) OVER (PARTITION BY service_date, flight_id) AS hi FROM (SELECT *, coalesce(flight, icao_hex) AS flight_id FROM labelled WHERE altitude_baro IS NOT NULL)) WHERE next_id IS NOT NULL", lambda p: rp.track_segments(p, TZ), "labelled")
on_points("hour_of_day", f"SELECT CAST(hour(ts AT TIME ZONE 'UTC' AT TIME ZONE '{TZ}') AS INT) AS hour, count(DISTINCT icao_hex) AS aircraft, count(*) AS records FROM points GROUP BY 1", lambda p: rp.hour_of_day(p, TZ))
on_points("peak_hour", f"SELECT hour, records FROM (SELECT CAST(hour(ts AT TIME ZONE 'UTC' AT TIME ZONE '{TZ}') AS INT) AS hour, count(*) AS records FROM points GROUP BY 1) ORDER BY records DESC, hour LIMIT 1", lambda p: rp.peak_hour(p, TZ))
on_points("dow_hour_heatmap", f"SELECT CAST(dayofweek(ts AT TIME ZONE 'UTC' AT TIME ZONE '{TZ}') AS INT) AS dow, CAST(hour(ts AT TIME ZONE 'UTC' AT TIME ZONE '{TZ}') AS INT) AS hour, count(DISTINCT icao_hex) AS aircraft FROM points GROUP BY 1, 2", lambda p: rp.dow_hour_heatmap(p, TZ))
on_points("percentile_filter", "SELECT event_id FROM points WHERE velocity >= (SELECT quantile_cont(velocity, 0.9) FROM points)", lambda p: rp.percentile_filter(p, "velocity", 0.9).select("event_id"))
on_points("scale_to_max", "SELECT event_id, round(velocity / (SELECT max(velocity) FROM points), 6) AS scaled FROM points", lambda p: rp.scale_to_max(p, "velocity").select("event_id", "scaled"))
on_points("backfill_completeness", "SELECT day, coalesce(n, 0) AS rows, n IS NOT NULL AS done FROM (SELECT CAST(unnest(generate_series(timestamp '2023-12-30', timestamp '2024-01-03', INTERVAL 1 DAY)) AS DATE) AS day) LEFT JOIN (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM points GROUP BY 1) USING (day)", lambda p: rp.backfill_completeness(p, "2023-12-30", "2024-01-03"))
# --- checkpoint throughput ---------------------------------------------------------------------
_TSA = "FROM tsa WHERE checkpoint IS NOT NULL AND d IS NOT NULL"


def _tsa(s: SparkSession, d: str) -> DataFrame:
    return rp.tsa_clean(fx.throughput(s, d))


query("tsa_daily", oracle(f"SELECT CAST(d AS DATE) AS day, CAST(sum(pax) AS BIGINT) AS passengers, count(*) AS rows {_TSA} GROUP BY 1", "tsa"))(lambda s, d: rp.tsa_totals(_tsa(s, d), "day"))
query("tsa_hourly", oracle(f"SELECT h AS hour, CAST(sum(pax) AS BIGINT) AS passengers, count(*) AS rows {_TSA} GROUP BY 1", "tsa"))(lambda s, d: rp.tsa_totals(_tsa(s, d), "hour"))
query("tsa_by_checkpoint", oracle(f"SELECT checkpoint, CAST(sum(pax) AS BIGINT) AS passengers, count(*) AS rows {_TSA} GROUP BY 1", "tsa"))(lambda s, d: rp.tsa_totals(_tsa(s, d), "checkpoint"))
query("tsa_heatmap", oracle(f"SELECT CAST(dayofweek(d) AS INT) AS dow, h AS hour, CAST(sum(pax) AS BIGINT) AS passengers {_TSA} GROUP BY 1, 2", "tsa"))(lambda s, d: rp.tsa_heatmap(_tsa(s, d)))
query("tsa_date_range", oracle(f"SELECT CAST(min(d) AS DATE) AS first_day, CAST(max(d) AS DATE) AS last_day {_TSA}", "tsa"))(lambda s, d: _tsa(s, d).where("day IS NOT NULL").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day")))
query("tsa_kpis", oracle(f"SELECT CAST(sum(pax) AS BIGINT) AS total, round(sum(pax) / count(DISTINCT d), 2) AS daily_average, count(DISTINCT checkpoint) AS checkpoints, (SELECT h FROM (SELECT h, sum(pax) AS p {_TSA} GROUP BY h) ORDER BY p DESC, h LIMIT 1) AS peak_hour {_TSA}", "tsa"))(lambda s, d: rp.tsa_kpis(_tsa(s, d)))

from airside import queries_airport, queries_flights, queries_reports, queries_sources, queries_state  # noqa: E402, F401  (they register the other queries)
