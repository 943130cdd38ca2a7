"""Queries of flight lists, tracks, gate dwell of flights, and runway crossings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airside import queries as base
from airside.functions import geo
from airside.functions.time import service_date
from airside.operators import gold, schedules, spatial
from airside.plans import crossing_reports as cr
from airside.plans import fixtures as fx
from airside.plans import flight_pages as fp
from airside.plans import reports as rp
from airside.queries_airport import local
from airside.registry import query
from airside.sources.files import stored

C = F.col
DAY = "2024-01-01"
FLIGHT = "DAL101"  # a callsign of the fixture

# --- lists and tracks ---------------------------------------------------------------------------


def _flights(s: SparkSession, d: str) -> DataFrame:
    return gold.flight_list(local(s, d), fx.ring())


@query("flight_list", "SELECT * FROM flight_list", "flight_list")
def flight_list(s: SparkSession, d: str) -> DataFrame:
    return _flights(s, d)


_PAGE = f"SELECT * FROM flight_list WHERE service_date = DATE '{DAY}' ORDER BY points DESC, flight_id LIMIT 500"


@query("flight_list_page", _PAGE, "flight_list")
def flight_list_page(s: SparkSession, d: str) -> DataFrame:
    return fp.flight_list_page(_flights(s, d), DAY)


_SPARSE = "SELECT * REPLACE (CASE WHEN points % 2 = 0 THEN airline_name END AS airline_name, CASE WHEN points % 2 = 0 THEN origin_airport END AS origin_airport) FROM flight_list"
_ENRICHED_LIST = f"""
SELECT * EXCLUDE (way), CASE WHEN vehicle_category IN ('TOWER', 'SERVICE_VEHICLE', 'GROUND_VEHICLE') THEN flight_id || ' | ' || CASE vehicle_category WHEN 'TOWER' THEN 'Tower' WHEN 'SERVICE_VEHICLE' THEN 'Service Vehicle' ELSE 'Ground Vehicle' END
  ELSE concat_ws(' | ', flight_id, airline_name, way) END AS label
FROM (SELECT l.service_date, l.flight_id, l.vehicle_category, coalesce(l.airline_name, h.airline_name, CASE WHEN l.vehicle_category NOT IN ('TOWER', 'SERVICE_VEHICLE', 'GROUND_VEHICLE') THEN coalesce(a3.airline_name, a2.airline_name) END) AS airline_name,
    coalesce(l.origin_airport, h.dep_airport) AS origin_airport, coalesce(l.destination_airport, h.arr_airport) AS destination_airport, coalesce(l.origin_airport, h.dep_airport) || '→' || coalesce(l.destination_airport, h.arr_airport) AS way
  FROM ({_SPARSE}) l LEFT JOIN (SELECT * FROM (SELECT i.flight_id, i.service_date, s.*, CASE WHEN flight_icao = flight_id THEN 0 ELSE 1 END AS rank, abs(date_diff('day', flight_date, service_date)) AS days
      FROM flight_list i JOIN schedule s ON abs(date_diff('day', flight_date, service_date)) <= 1 AND (flight_icao = flight_id OR flight_iata = flight_id))
    QUALIFY row_number() OVER (PARTITION BY flight_id, service_date ORDER BY rank, days, updated_at DESC, schedule_key) = 1) h USING (flight_id, service_date)
  LEFT JOIN airlines a3 ON a3.airline_icao = substr(regexp_replace(flight_id, '[^A-Z]', '', 'g'), 1, 3) LEFT JOIN airlines a2 ON a2.airline_iata = substr(regexp_replace(flight_id, '[^A-Z]', '', 'g'), 1, 2))"""


@query("flight_list_enriched", _ENRICHED_LIST, "flight_list", "schedule", "airlines")
def flight_list_enriched(s: SparkSession, d: str) -> DataFrame:
    """Every other flight of the list lacks its airline and origin."""
    sparse = {c: F.when(C("points") % 2 == 0, C(c)) for c in ("airline_name", "origin_airport")}
    flights = fx.schedule(s, d)
    names = schedules.airline_name_map(flights, fx.airlines(s))
    found = fp.flight_list_enriched(stored(_flights(s, d), "flights").withColumns(sparse), flights, names)
    return found.select("service_date", "flight_id", "vehicle_category", "airline_name", "origin_airport", "destination_airport", "label")


_TRACK = f"SELECT * FROM labelled WHERE flight = '{FLIGHT}' AND service_date = DATE '{DAY}'"


@query("flight_track", f"SELECT event_id, icao_hex, ts, lat, lon, altitude_baro, velocity FROM ({_TRACK}) UNION ALL SELECT event_id, icao_hex, ts, lat, lon, altitude_baro, velocity FROM labelled WHERE icao_hex = 'A00007' AND service_date = DATE '{DAY}'", "labelled")
def flight_track(s: SparkSession, d: str) -> DataFrame:
    p = fx.points(s, d)
    both = fp.flight_track(p, FLIGHT, DAY, fx.TZ).unionByName(fp.flight_track(p, "a00007", DAY, fx.TZ))
    return both.select("event_id", "icao_hex", "ts", "lat", "lon", "altitude_baro", "velocity")


@query("flight_profile", f"SELECT event_id, ts AT TIME ZONE 'UTC' AT TIME ZONE '{fx.TZ}' AS local_ts, CAST(altitude_baro AS DOUBLE) AS altitude, velocity AS speed FROM ({_TRACK}) WHERE altitude_baro IS NOT NULL", "labelled")
def flight_profile(s: SparkSession, d: str) -> DataFrame:
    return fp.flight_profile(fp.flight_track(fx.points(s, d), FLIGHT, DAY, fx.TZ), fx.TZ)


def _dated(s: SparkSession, d: str) -> DataFrame:
    from airside.functions import flight as fl

    return fx.points(s, d).withColumn("service_date", service_date(C("ts"), fx.TZ)).withColumn("flight_id", fl.flight_id(C("flight"), C("icao_hex")))


@query(
    "flight_gate_dwell",
    f"""SELECT flight_id, service_date, gate_id, points, start_ts, end_ts, date_diff('minute', start_ts, end_ts) AS dwell_minutes FROM
      (SELECT coalesce(p.flight, p.icao_hex) AS flight_id, p.service_date, g.gate_id, count(*) AS points, min(p.ts) AS start_ts, max(p.ts) AS end_ts FROM labelled p JOIN gates g ON {fx.METRES.format(a="p", b="g")} <= 120 GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY flight_id, service_date ORDER BY points DESC, gate_id) = 1""",
    "labelled", "gates",
)
def flight_gate_dwell(s: SparkSession, d: str) -> DataFrame:
    return fp.flight_gate_dwell(_dated(s, d), fx.gates(s, d))


@query("gate_time_lookup", "SELECT service_date, gate_id, CAST(round(seconds / 60.0) AS BIGINT) AS dwell_minutes FROM gate_time SEMI JOIN (SELECT DISTINCT icao_hex, service_date, session_seq FROM near WHERE icao_hex = 'A00007' OR flight = 'A00007') USING (icao_hex, service_date, session_seq) QUALIFY row_number() OVER (PARTITION BY service_date ORDER BY seconds DESC, icao_hex, session_seq) = 1", "gate_time", "near")
def gate_time_lookup(s: SparkSession, d: str) -> DataFrame:
    at_gates = base._at_gates(s, d)
    return fp.gate_time_lookup(at_gates, gold.flight_gate_time(at_gates), "A00007")


@query("od_for_flights", f"SELECT service_date, flight_id, origin_airport, destination_airport FROM flight_list WHERE flight_id IN ('{FLIGHT}', 'AAL106', 'UAL102')", "flight_list")
def od_for_flights(s: SparkSession, d: str) -> DataFrame:
    return fp.od_for_flights(_flights(s, d), [FLIGHT, "AAL106", "UAL102"])


_HEX = fx.hexagon("lat", "lon", 0.01)
_CELLS = f"SELECT *, {_HEX} FROM points"
_NAMES = "SELECT q, r, flight FROM ({cells}) WHERE flight IS NOT NULL GROUP BY q, r, flight QUALIFY row_number() OVER (PARTITION BY q, r ORDER BY flight) <= 15"
_DENSE = f"""SELECT d.q, d.r, d.aircraft, round(d.n / 30.0, 4) AS points_per_day, n.callsigns FROM (SELECT q, r, count(*) AS n, count(DISTINCT icao_hex) AS aircraft FROM ({{cells}}) GROUP BY q, r ORDER BY n DESC, q, r LIMIT 4000) d
  LEFT JOIN (SELECT q, r, string_agg(flight, ',' ORDER BY flight) AS callsigns FROM ({_NAMES}) GROUP BY q, r) n USING (q, r)"""


@query("hex_density", _DENSE.format(cells=_CELLS), "points")
def hex_density(s: SparkSession, d: str) -> DataFrame:
    return rp.hex_density(fx.points(s, d), 0.01, 30)


_BOX = (31.99, -117.01, 32.01, -116.99)


@query("hex_density_box", _DENSE.format(cells=f"{_CELLS} WHERE lat BETWEEN {_BOX[0]} AND {_BOX[2]} AND lon BETWEEN {_BOX[1]} AND {_BOX[3]}"), "points")
def hex_density_box(s: SparkSession, d: str) -> DataFrame:
    return rp.hex_density(fx.points(s, d), 0.01, 30, box=_BOX)


@query("callsigns_by_category", f"SELECT q, r, vehicle_category, string_agg(flight, ',' ORDER BY flight) AS callsigns FROM (SELECT q, r, vehicle_category, flight FROM (SELECT *, {_HEX} FROM labelled) WHERE flight IS NOT NULL GROUP BY q, r, vehicle_category, flight QUALIFY row_number() OVER (PARTITION BY q, r, vehicle_category ORDER BY flight) <= 15) GROUP BY ALL", "labelled")
def callsigns_by_category(s: SparkSession, d: str) -> DataFrame:
    from airside.functions import flight as fl

    q, r = geo.hex_cell(C("lat"), C("lon"), 0.01)
    rows = fx.points(s, d).select(q.alias("q"), r.alias("r"), fl.vehicle_category(C("category"), C("type")).alias("vehicle_category"), "flight")
    return fp.callsigns_by_category(rows)


@query("bernoulli_sample")
def bernoulli_sample(s: SparkSession, d: str) -> DataFrame:
    """A tenth of the points, drawn row by row with a seed."""
    return fx.points(s, d).sample(0.1, 7).select("event_id")


@query("extent", f"SELECT q, r, min(lat) AS min_lat, min(lon) AS min_lon, max(lat) AS max_lat, max(lon) AS max_lon FROM ({_CELLS}) GROUP BY q, r", "points")
def extent(s: SparkSession, d: str) -> DataFrame:
    """The box around the points of each hexagon."""
    q, r = geo.hex_cell(C("lat"), C("lon"), 0.01)
    rows = fx.points(s, d).withColumn("q", q).withColumn("r", r)
    return rows.groupBy("q", "r").agg(F.min("lat").alias("min_lat"), F.min("lon").alias("min_lon"), F.max("lat").alias("max_lat"), F.max("lon").alias("max_lon"))


# --- runway crossings ------------------------------------------------------------------------------


def _keyed(s: SparkSession, d: str) -> DataFrame:
    return cr.keyed_points(fx.points(s, d), fx.TZ)


def crossings(s: SparkSession, d: str) -> DataFrame:
    return spatial.runway_crossings(_keyed(s, d), fx.runways(s))


def events(s: SparkSession, d: str) -> DataFrame:
    """Points of the fixture lie minutes apart, so wide limits stand for the usual ones."""
    return cr.crossing_events(spatial.plausible_crossings(crossings(s, d), seconds=7200, metres=5000), cr.flights_of(_keyed(s, d)))


_STAY = "flight_key, runway_id, event, t_entry, t_exit, seconds, chord_m, max_speed, direction"
STAY = _STAY.split(", ")


@query("runway_crossings", f"SELECT {_STAY} FROM crossings", "crossings")
def runway_crossings(s: SparkSession, d: str) -> DataFrame:
    return crossings(s, d).select(*STAY)


@query("plausible_crossings", f"SELECT {_STAY} FROM crossings WHERE max_speed <= 80 AND seconds <= 300 AND chord_m <= 500 AND direction <> 'uncertain'", "crossings")
def plausible_crossings(s: SparkSession, d: str) -> DataFrame:
    return spatial.plausible_crossings(crossings(s, d)).select(*STAY)


@query("enter_exit_flags", "SELECT event_id, runway_id, inside AND NOT before AS enters, inside AND NOT coalesce(lead(inside) OVER (PARTITION BY flight_key, runway_id ORDER BY ts, event_id), false) AS leaves, event FROM islands SEMI JOIN (SELECT DISTINCT flight_key, runway_id FROM islands WHERE inside) USING (flight_key, runway_id)", "islands")
def enter_exit_flags(s: SparkSession, d: str) -> DataFrame:
    return spatial.runway_stays(_keyed(s, d), fx.runways(s)).select("event_id", "runway_id", "enters", "leaves", "event")


@query("crossing_direction", "SELECT flight_key, runway_id, event, direction FROM crossings", "crossings")
def crossing_direction(s: SparkSession, d: str) -> DataFrame:
    return crossings(s, d).select("flight_key", "runway_id", "event", "direction")


@query("chord_midpoint", "SELECT flight_key, runway_id, event, round(mid_lat, 6) AS lat, round(mid_lon, 6) AS lon, chord_m FROM crossings", "crossings")
def chord_midpoint(s: SparkSession, d: str) -> DataFrame:
    return crossings(s, d).select("flight_key", "runway_id", "event", F.round("midpoint.lat", 6).alias("lat"), F.round("midpoint.lon", 6).alias("lon"), "chord_m")


@query("crossing_events", "SELECT flight_key, runway_id, t_entry, direction, seconds, flight_number, airline_code, service_date FROM crossing_events", "crossing_events")
def crossing_events(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).select("flight_key", "runway_id", "t_entry", "direction", "seconds", "flight_number", "airline_code", "service_date")


@query("crossing_summary", "SELECT round(count(DISTINCT flight_key) / 2) AS total_flights, round(count(*) / 2) AS total_crossings, round(avg(seconds), 3) AS avg_duration_s, round(sum(seconds) / 60.0 / 2) AS total_duration_min FROM crossing_events", "crossing_events")
def crossing_summary(s: SparkSession, d: str) -> DataFrame:
    from airside.functions import flight as fl

    return cr.crossing_summary(events(s, d), fl.aggregation_divisor("daily_average", "2023-12-31", "2024-01-01"))


@query("agg_divisor", "SELECT service_date, count(*) / 1 AS summed, round(count(*) / 31.0, 4) AS daily_average FROM labelled GROUP BY service_date", "labelled")
def agg_divisor(s: SparkSession, d: str) -> DataFrame:
    from airside.functions import flight as fl

    by = lambda kind: F.count("*") / fl.aggregation_divisor(kind, "2024-01-01", "2024-01-31")
    return _dated(s, d).groupBy("service_date").agg(by("sum").alias("summed"), F.round(by("daily_average"), 4).alias("daily_average"))


@query("crossing_cells", f"SELECT q, r, count(DISTINCT flight_key) AS flights, round(sum(seconds) / 60.0, 1) AS minutes, round(arg_min(mid_lat, (t_entry, flight_key, runway_id, event)), 6) AS lat, round(arg_min(mid_lon, (t_entry, flight_key, runway_id, event)), 6) AS lon FROM (SELECT *, {fx.hexagon('mid_lat', 'mid_lon', 0.001)} FROM crossing_events) GROUP BY q, r HAVING sum(seconds) > 0 AND round(sum(seconds) / 60.0, 1) > 0", "crossing_events")
def crossing_cells(s: SparkSession, d: str) -> DataFrame:
    return cr.crossing_cells(events(s, d), 0.001, "minutes")


@query("crossing_details", "SELECT flight_key, runway_id, t_entry, t_exit, direction, seconds, round(seconds / 60.0, 2) AS minutes, round(max_speed, 1) AS max_speed, chord_m, flight_number, airline_code FROM crossing_events ORDER BY t_entry DESC, flight_key, runway_id, event LIMIT 100", "crossing_events")
def crossing_details(s: SparkSession, d: str) -> DataFrame:
    return cr.crossing_details(events(s, d))


_WAY = "SELECT flight_key, service_date AS crossing_date, direction FROM (SELECT flight_key, service_date, direction, count(*) AS n FROM crossing_events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY flight_key, service_date ORDER BY n DESC, direction) = 1"


@query(
    "crossing_paths",
    f"""SELECT w.flight_key, p.event_id, w.crossing_date, w.direction, s.dep_airport AS origin_airport, s.arr_airport AS destination_airport
    FROM ({_WAY}) w JOIN (SELECT *, md5(icao_hex || ':' || CAST(service_date AS VARCHAR)) AS flight_key FROM labelled) p USING (flight_key)
    LEFT JOIN (SELECT * FROM schedule QUALIFY row_number() OVER (PARTITION BY flight_date, flight_number ORDER BY updated_at DESC, schedule_key) = 1) s ON s.flight_date = w.crossing_date AND s.flight_number = nullif(regexp_extract(p.flight, '[0-9]+'), '')""",
    "crossing_events", "labelled", "schedule",
)
def crossing_paths(s: SparkSession, d: str) -> DataFrame:
    return cr.crossing_paths(events(s, d), _keyed(s, d), fx.schedule(s, d))


@query("crossing_dow_hour", f"SELECT CAST(dayofweek(l) AS INT) AS dow, CAST(hour(l) AS INT) AS hour, count(*) AS crossings FROM (SELECT t_entry AT TIME ZONE 'UTC' AT TIME ZONE '{fx.TZ}' AS l FROM crossing_events) GROUP BY 1, 2", "crossing_events")
def crossing_dow_hour(s: SparkSession, d: str) -> DataFrame:
    return cr.crossing_dow_hour(events(s, d), fx.TZ)


_BY = "{key}, count(*) AS crossings, CAST(sum(seconds) AS BIGINT) AS seconds, round(avg(seconds), 1) AS avg_seconds, round(sum(seconds) / 60.0, 2) AS minutes"


@query("crossing_by_direction", f"SELECT {_BY.format(key='direction')} FROM crossing_events GROUP BY direction", "crossing_events")
def crossing_by_direction(s: SparkSession, d: str) -> DataFrame:
    return cr.crossing_by(events(s, d), "direction")


@query(
    "crossing_by_flight_type",
    """SELECT coalesce(upper(substr(t.direction, 1, 1)) || substr(t.direction, 2), 'Unknown') AS flight_type, count(*) AS crossings, CAST(sum(seconds) AS BIGINT) AS seconds, round(sum(seconds) / 60.0, 2) AS minutes
    FROM crossing_events e LEFT JOIN (SELECT icao_hex, service_date, direction FROM (SELECT icao_hex, service_date, direction, count(*) AS n FROM legs WHERE direction <> 'unknown' GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY icao_hex, service_date ORDER BY n DESC, direction) = 1) t USING (icao_hex, service_date) GROUP BY 1""",
    "crossing_events", "legs",
)
def crossing_by_flight_type(s: SparkSession, d: str) -> DataFrame:
    return cr.crossing_by_flight_type(events(s, d), base._legs(s, d))


_AT_GATE = "SELECT e.*, g.gate_id, g.session_seq FROM crossing_events e JOIN gate_time g ON g.icao_hex = e.icao_hex AND g.service_date = e.service_date AND g.flight = e.flight_number"


def _at_gate(s: SparkSession, d: str) -> DataFrame:
    return cr.crossing_gate_join(events(s, d), gold.flight_gate_time(base._at_gates(s, d)))


@query("crossing_gate_join", f"SELECT flight_key, runway_id, event, gate_id, session_seq FROM ({_AT_GATE})", "crossing_events", "gate_time")
def crossing_gate_join(s: SparkSession, d: str) -> DataFrame:
    return _at_gate(s, d).select("flight_key", "runway_id", "event", "gate_id", "session_seq")


@query("crossing_by_gate", f"SELECT gate_id, unnest(['S→N', 'N→S']) AS direction, unnest([a, b]) AS crossings FROM (SELECT gate_id, count(*) FILTER (direction = 'S→N') AS a, count(*) FILTER (direction = 'N→S') AS b FROM ({_AT_GATE}) GROUP BY gate_id ORDER BY a + b DESC, gate_id LIMIT 15)", "crossing_events", "gate_time")
def crossing_by_gate(s: SparkSession, d: str) -> DataFrame:
    return cr.crossing_by_gate(_at_gate(s, d))


@query("crossing_top_airlines", f"SELECT {_BY.format(key='airline_code')} FROM crossing_events WHERE airline_code <> 'UNK' GROUP BY airline_code ORDER BY crossings DESC, airline_code LIMIT 10", "crossing_events")
def crossing_top_airlines(s: SparkSession, d: str) -> DataFrame:
    return cr.crossing_by(events(s, d).where("airline_code <> 'UNK'"), "airline_code").orderBy(C("crossings").desc(), "airline_code").limit(10)


@query("crossing_top_flights", f"SELECT {_BY.format(key='flight_number')} FROM crossing_events WHERE flight_number IS NOT NULL GROUP BY flight_number ORDER BY crossings DESC, flight_number LIMIT 10", "crossing_events")
def crossing_top_flights(s: SparkSession, d: str) -> DataFrame:
    return cr.crossing_by(events(s, d).where("flight_number IS NOT NULL"), "flight_number").orderBy(C("crossings").desc(), "flight_number").limit(10)


@query("gate_for_flight_keys", "SELECT flight_key, gate_id, seconds FROM (SELECT md5(icao_hex || ':' || CAST(service_date AS VARCHAR)) AS flight_key, gate_id, CAST(sum(coalesce(lag_seconds, 0)) AS BIGINT) AS seconds FROM near WHERE gate_id IS NOT NULL GROUP BY ALL) SEMI JOIN (SELECT DISTINCT flight_key FROM crossing_events) USING (flight_key) QUALIFY row_number() OVER (PARTITION BY flight_key ORDER BY seconds DESC, gate_id) = 1", "near", "crossing_events")
def gate_for_flight_keys(s: SparkSession, d: str) -> DataFrame:
    return cr.gate_for_flight_keys(base._at_gates(s, d), events(s, d).select("flight_key").distinct())


@query("flight_sample", "SELECT event_id FROM labelled SEMI JOIN (SELECT icao_hex, service_date FROM (SELECT DISTINCT icao_hex, service_date FROM labelled) ORDER BY md5('seed' || md5(icao_hex || ':' || CAST(service_date AS VARCHAR))) LIMIT 20) USING (icao_hex, service_date)", "labelled")
def flight_sample(s: SparkSession, d: str) -> DataFrame:
    return cr.flight_sample(_keyed(s, d), 20, "seed").select("event_id")

