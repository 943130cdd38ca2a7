"""Queries of what keeps state: streams with late rows, versioned tables, the refresh of derived tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airside.functions.time import service_date
from airside.operators import gold, keyed, positions, sessions
from airside.operators.airports import of_airports
from airside.plans import fixtures as fx
from airside.plans.cascade import SILVER, STEPS, Airport, Cascade
from airside.plans.fixtures import AIRCRAFT, TZ
from airside.queries_sources import _at, _landed, _plain, _run, _utc
from airside.registry import query
from airside.sources import files
from airside.sources.versions import VersionedTable
from airside.streaming import jobs

C = F.col
_END = "2030-01-01 00:00:00"


def landings(s: SparkSession, parts: Iterable[DataFrame], end: bool = True) -> DataFrame:
    """A stream in which each part is a file of its own and comes in a micro-batch of its own, in this order.

    With ``end`` a last row of aircraft ~ moves the watermark past all others.
    """
    path, schema = files.scratch(s, "stream"), None
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
        schema = part.schema
    if end:
        far = part.limit(1).withColumns({"icao_hex": F.lit("~"), "event_id": F.lit(-1).cast("long"), "ts": _at(_END)})
        far.coalesce(1).write.mode("append").parquet(path)
    return s.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def instants(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """The points, stored, with instants and their airport-local day."""
    p = fx.points(s, d).withColumn("service_date", service_date(C("ts"), TZ)).withColumn("ts", _utc("ts"))
    return files.stored(p.select("event_id", "icao_hex", "ts", "service_date", *columns), "instants")


# --- streams -----------------------------------------------------------------------------------------
@query("stream_legs", "SELECT icao_hex, service_date, segment, start_ts, end_ts, points FROM legs", "legs")
def stream_legs(s: SparkSession, d: str) -> DataFrame:
    """The points come up to an hour after their time, so that micro-batches overlap and are out of order."""
    p = instants(s, d, "velocity", "altitude_baro").drop("service_date")
    coming = (F.unix_seconds("ts") + C("event_id") * 7919 % 3600) % 86400
    parts = [p.where((coming >= lo * 14400) & (coming < (lo + 1) * 14400)) for lo in range(4)]
    found = _run(s, jobs.stream_legs(landings(s, parts), TZ, "2 hours")).where("icao_hex <> '~'")
    return found.select("icao_hex", "service_date", "segment", _plain("start_ts").alias("start_ts"), _plain("end_ts").alias("end_ts"), "points")


_NEWEST = "icao_hex string, ts timestamp, event_id long, service_date date"


def newest_wins(known: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each aircraft and time: that of the greatest event_id."""
    return keyed.top_per_key(known.unionByName(new), ["icao_hex", "ts"], [C("event_id").desc()])


@query("stream_upsert", "SELECT icao_hex, ts, max(event_id) AS event_id FROM points GROUP BY ALL", "points")
def stream_upsert(s: SparkSession, d: str) -> DataFrame:
    """Micro-batches merge into a versioned table; a batch that comes again changes nothing."""
    p = instants(s, d)
    table = VersionedTable(s, files.scratch(s, "newest"), _NEWEST)
    stream = landings(s, [p.where("event_id % 3 = 0"), p.where("event_id % 3 = 1"), p.where("event_id % 3 = 2")], end=False)
    jobs.stream_upsert(stream.select("icao_hex", "ts", "event_id", "service_date"), table, newest_wins, files.scratch(s, "checkpoint")).awaitTermination()
    again = p.select("icao_hex", "ts", (C("event_id") + 1_000_000).alias("event_id"), "service_date")
    table.merge(again, newest_wins, "stream", 1)  # a batch of this number is there already
    return table.read().select("icao_hex", _plain("ts").alias("ts"), "event_id")


_LATE_ROWS = """
SELECT event_id, event_id % 10 = 3 AND ts <= (SELECT max(ts) - INTERVAL 2 HOUR FROM points WHERE event_id % 10 <> 3) AS late
FROM points
"""


def _with_late(s: SparkSession, d: str) -> tuple[VersionedTable, VersionedTable, VersionedTable]:
    """Points of which every tenth comes after all others: the table, its late rows, and ground sessions by day."""
    p = instants(s, d, "velocity", "altitude_baro", "lat", "lon")
    first = p.where("event_id % 10 <> 3")
    table, side = (VersionedTable(s, files.scratch(s, tag), p.schema) for tag in ("by-day", "late"))
    plain = lambda rows: rows.withColumn("ts", _plain("ts")).drop("service_date")
    stays = VersionedTable(s, files.scratch(s, "stays"), sessions.ground_sessions(plain(p), TZ).schema)

    def again(days: list[str]) -> None:
        found = stays.manifest()
        written = stays.stage(sessions.ground_sessions(plain(table.read(days=days)), TZ))
        stays.publish(found, dict.fromkeys(days) | written)

    for rows in (first, p.where("event_id % 10 = 3")):
        path = _landed(s, rows, "part")
        stream = s.readStream.schema(p.schema).parquet(path)
        jobs.stream_late(stream, table, side, files.scratch(s, "checkpoint"), "2 hours", again, writer=f"late-{path[-8:]}").awaitTermination()
        if rows is first:
            again(sorted(table.folders()))
    return table, side, stays


@query("stream_late", _LATE_ROWS, "points")
def stream_late(s: SparkSession, d: str) -> DataFrame:
    table, side, _ = _with_late(s, d)
    late = side.read().groupBy("event_id").agg(F.count("*").alias("times"))
    return table.read().join(late, "event_id", "left").select("event_id", (F.coalesce("times", F.lit(0)) == 1).alias("late"))


_SESSIONS = """
SELECT icao_hex, service_date, session_seq, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS points
FROM sessions GROUP BY icao_hex, service_date, session_seq
"""


@query("stream_late_days", _SESSIONS, "sessions")
def stream_late_days(s: SparkSession, d: str) -> DataFrame:
    """Ground sessions after the days that late rows touched were worked through again: those of the batch."""
    return _with_late(s, d)[2].read().select("icao_hex", "service_date", "session_seq", "start_ts", "end_ts", "points")


# --- versioned tables --------------------------------------------------------------------------------
_MERGED = """
SELECT coalesce(t.icao_hex, b.icao_hex) AS icao_hex, coalesce(t.ts, b.ts) AS ts, coalesce(t.event_id, b.event_id) AS event_id
FROM (SELECT icao_hex, ts, max(event_id) AS event_id FROM points WHERE event_id % 2 = 0 GROUP BY ALL) t
FULL JOIN (SELECT icao_hex, ts, max(event_id) AS event_id FROM labelled WHERE event_id % 2 = 1 AND service_date = DATE '2024-01-01' GROUP BY ALL) b
  ON t.icao_hex = b.icao_hex AND t.ts = b.ts
"""


@query("versioned_positions", _MERGED, "labelled")
def versioned_positions(s: SparkSession, d: str) -> DataFrame:
    """Raw positions of one day merged into a table of all days by the upsert of positions."""
    raw = fx.points(s, d).withColumn("ingested_at", C("ts"))
    dated = lambda rows: positions.normalise(rows).withColumn("service_date", service_date(C("ts"), TZ))
    how = lambda known, new: positions.etl_upsert(known, new).select(*known.columns)
    even, odd = raw.where("event_id % 2 = 0"), raw.where("event_id % 2 = 1")
    table = VersionedTable(s, files.scratch(s, "positions"), dated(raw).schema)
    table.merge(files.stored(dated(even), "even"), how, "daily", 1)
    table.merge(files.stored(dated(odd).where("service_date = DATE'2024-01-01'"), "odd"), how, "daily", 2)
    return table.read().select("icao_hex", "ts", "event_id")


# --- derived tables ----------------------------------------------------------------------------------
#: What of each derived table is compared: its columns as text, the same in both engines. Times are seconds, fractions hundredths.
_TEXTS = {
    "adsb_local": "event_id, service_date, flight_id, airline_icao, airline_iata, schedule_key, match_confidence, origin_airport, vehicle_category",
    "ground_sessions": "icao_hex, service_date, session_seq, {start_ts}, {end_ts}, points",
    "ground_points": "event_id, service_date, session_seq, gate_id, lag_seconds",
    "flight_gate_time": "icao_hex, service_date, session_seq, gate_id, seconds, points, flight",
    "gate_util_daily": "service_date, gate_id, vehicle_category, [dwell_minutes], sessions",
    "gate_airline_dwell_daily": "service_date, gate_id, airline_code, dwell_seconds, sessions",
    "flight_dwell_with_airline": "flight_number, airline_code, airline_name, service_date, icao_hex, session_seq, gate_id, dwell_minutes, vehicle_category",
    "traffic_daily": "service_date, vehicle_category, aircraft, flights, records, [avg_altitude], [avg_speed]",
    "traffic_hourly": "{hour}, aircraft, records",
    "flight_list": "service_date, flight_id, points, {first_ts}, {last_ts}, icao_hex, airline_name, schedule_flight_number, is_local_od, touched",
    "airline_traffic_daily": "service_date, airline, flights, aircraft, records",
    "airline_delay_daily": "flight_date, airline_icao, flights, delay_minutes, delayed, early_minutes, early",
    "runway_crossings": "flight_key, runway_id, event, {t_entry}, {t_exit}, seconds, [chord_m], direction",
}
_FROM = {
    "adsb_local": "local",
    "ground_sessions": f"({_SESSIONS})",
    "ground_points": "near",
    "flight_gate_time": "gate_time",
    "gate_util_daily": """(SELECT service_date, gate_id, vehicle_category, round(sum(coalesce(lag_seconds, 0)) / 60.0, 2) AS dwell_minutes,
        count(DISTINCT (icao_hex, session_seq)) AS sessions FROM near WHERE gate_id IS NOT NULL GROUP BY ALL)""",
    "gate_airline_dwell_daily": f"""(SELECT n.service_date, n.gate_id, CASE WHEN n.vehicle_category IN {AIRCRAFT} THEN coalesce(l.airline_icao, l.airline_iata, 'UNK') ELSE n.vehicle_category END AS airline_code,
        CAST(sum(coalesce(lag_seconds, 0)) AS BIGINT) AS dwell_seconds, count(DISTINCT (n.icao_hex, session_seq)) AS sessions
        FROM near n LEFT JOIN local l USING (event_id) WHERE n.gate_id IS NOT NULL GROUP BY 1, 2, 3)""",
    "flight_dwell_with_airline": "dwell",
    "traffic_daily": """(SELECT service_date, vehicle_category, count(DISTINCT icao_hex) AS aircraft, count(DISTINCT flight) AS flights, count(*) AS records,
        round(avg(altitude_baro), 3) AS avg_altitude, round(avg(velocity), 3) AS avg_speed FROM labelled GROUP BY ALL)""",
    "traffic_hourly": "(SELECT date_trunc('hour', ts) AS hour, count(DISTINCT icao_hex) AS aircraft, count(*) AS records FROM points GROUP BY ALL)",
    "flight_list": "flight_list",
    "airline_traffic_daily": f"""(SELECT service_date, upper(substr(flight, 1, 3)) AS airline, count(DISTINCT flight) AS flights, count(DISTINCT icao_hex) AS aircraft, count(*) AS records
        FROM labelled WHERE flight IS NOT NULL AND vehicle_category IN {AIRCRAFT} GROUP BY ALL)""",
    "airline_delay_daily": "delays",
    "runway_crossings": "crossings",
}


def _text(name: str, seconds: str, kind: str) -> str:
    """The compared columns as one SQL expression."""
    parts = []
    for c in _TEXTS[name].split(", "):
        inner = c.strip("{}[]")
        value = seconds.format(inner) if c.startswith("{") else f"CAST(floor({inner} * 100) AS BIGINT)" if c.startswith("[") else inner
        parts.append(f"coalesce(CAST({value} AS {kind}), '-')")
    return " || '|' || ".join(parts)


_CASCADE = " UNION ALL ".join(f"SELECT '{n}' AS table_name, {_text(n, 'CAST(epoch({}) AS BIGINT)', 'VARCHAR')} AS content FROM {_FROM[n]}" for n in _TEXTS)


def airport(s: SparkSession, d: str) -> Airport:
    """The fixture's airport with its gates, runways and airlines."""
    return Airport([fx.AIRPORT, "KTST"], TZ, fx.ring(), fx.gates(s, d), fx.runways(s), fx.airlines(s))


def late_cascade(s: SparkSession, d: str) -> tuple[Cascade, list[dict[str, list[str]]]]:
    """Derived tables after a first refresh without some points of one day, and after these have come; the days that each refresh changed."""
    p = fx.points(s, d).withColumn("service_date", service_date(C("ts"), TZ))
    schedule = fx.schedule(s, d)
    cascade = Cascade(s, files.scratch(s, "tables"), airport(s, d))
    late = (C("event_id") % 10 == 3) & (C("service_date") == F.lit("2024-01-01").cast("date"))
    add = lambda known, new: known.unionByName(new)
    points = cascade.source("points", p, "service_date")
    points.merge(files.stored(p.where(~late), "early"), add, "points", 1)
    cascade.source("schedule", schedule, "flight_date").merge(files.stored(schedule, "schedule"), add, "schedule", 1)
    changed = [cascade.refresh()]
    points.merge(files.stored(p.where(late), "late"), add, "points", 2)
    return cascade, [*changed, cascade.refresh()]


@query("refresh_cascade", _CASCADE, "local", "near", "gate_time", "dwell", "flight_list", "delays", "crossings")
def refresh_cascade(s: SparkSession, d: str) -> DataFrame:
    """All thirteen derived tables after a late batch, as rows of text: what a refresh of everything gives."""
    cascade, _ = late_cascade(s, d)
    found = None
    for name in STEPS:
        if name not in SILVER:
            rows = cascade.tables[name].read().select(F.lit(name).alias("table_name"), F.expr(_text(name, "unix_seconds(CAST({} AS TIMESTAMP))", "STRING")).alias("content"))
            found = rows if found is None else found.unionByName(rows)
    return found


# --- many airports -----------------------------------------------------------------------------------
#: A second airport far in the north: there are the points of odd aircraft, moved by so many ten-thousandths of a degree.
NORTH, NORTH_TZ, NORTH_LAT, NORTH_LON = "NOR", "Europe/Oslo", 376500, 1359000


def _moved(c: str, by: int) -> str:
    return f"({c} * 10000 + {by}) / CAST(10000 AS DOUBLE)"


def _ring(lat: float, lon: float) -> str:
    corners = [(-0.01, -0.01), (0.01, -0.01), (0.01, 0.01), (-0.01, 0.01), (-0.01, -0.01)]
    return "array(" + ", ".join(f"named_struct('lon', {lon + x:.4f}D, 'lat', {lat + y:.4f}D)" for x, y in corners) + ")"


def two_airports(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points of both airports with code and zone, the airports, and the gates of both."""
    north = lambda c, by, flag: f"CASE WHEN {flag} THEN {_moved(c, by)} ELSE {c} END"
    p = fx.points(s, d).selectExpr("* EXCEPT (lat, lon)", f"{north('lat', NORTH_LAT, 'user_id % 2 = 1')} AS lat", f"{north('lon', NORTH_LON, 'user_id % 2 = 1')} AS lon")
    airports = s.sql(f"SELECT '{fx.AIRPORT}' AS airport_code, '{TZ}' AS tz, {_ring(32.0, -117.0)} AS ring UNION ALL SELECT '{NORTH}', '{NORTH_TZ}', {_ring(69.65, 18.9)}")
    g = fx.gates(s, d).drop("gate_name")
    both = g.withColumn("airport_code", F.lit(fx.AIRPORT)).unionByName(g.selectExpr("gate_id", f"{_moved('lat', NORTH_LAT)} AS lat", f"{_moved('lon', NORTH_LON)} AS lon", f"'{NORTH}' AS airport_code"))
    return of_airports(p, airports), airports, both


def _within(lat: float, lon: float, metres: int, name: str = "", y: str = "lat", x: str = "lon") -> str:
    return f"""sqrt(pow(greatest(0, abs({y} - {lat}) - 0.01), 2) + pow(greatest(0, abs({x} - {lon}) - 0.01) * cos(radians({y})), 2)) * 6371000.0 * pi() / 180 <= {metres}"""


_NORTHERN = f"""
moved AS MATERIALIZED (
  SELECT * REPLACE (CASE WHEN user_id % 2 = 1 THEN {_moved('lat', NORTH_LAT)} ELSE lat END AS lat, CASE WHEN user_id % 2 = 1 THEN {_moved('lon', NORTH_LON)} ELSE lon END AS lon),
    CASE WHEN user_id % 2 = 1 THEN '{NORTH}' ELSE '{fx.AIRPORT}' END AS airport_code FROM points),
near_airports AS MATERIALIZED (
  SELECT *, CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE CASE airport_code WHEN '{NORTH}' THEN '{NORTH_TZ}' ELSE '{TZ}' END AS DATE) AS service_date
  FROM moved WHERE CASE airport_code WHEN '{NORTH}' THEN {_within(69.65, 18.9, 50000)} ELSE {_within(32.0, -117.0, 50000)} END),
flags AS (SELECT *, velocity <= 40 AND (altitude_baro IS NULL OR altitude_baro <= 50) AS is_ground FROM near_airports),
breaks AS (
  SELECT *, CASE WHEN coalesce(date_diff('minute', lag(ts) OVER w, ts), 999999) > 20 OR coalesce(lag(is_ground) OVER w <> is_ground, false) THEN 1 ELSE 0 END AS opens
  FROM flags WINDOW w AS (PARTITION BY airport_code, icao_hex, service_date ORDER BY ts, event_id)),
parts AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY airport_code, icao_hex, service_date ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM breaks),
ends AS (
  SELECT airport_code, icao_hex, service_date, segment, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS points, arg_min(lat, (ts, event_id)) AS alat, arg_min(lon, (ts, event_id)) AS alon,
    arg_max(lat, (ts, event_id)) AS zlat, arg_max(lon, (ts, event_id)) AS zlon FROM parts WHERE NOT is_ground GROUP BY ALL),
near_ends AS (
  SELECT *, CASE airport_code WHEN '{NORTH}' THEN {_within(69.65, 18.9, 5000, '', 'alat', 'alon')} ELSE {_within(32.0, -117.0, 5000, '', 'alat', 'alon')} END AS na,
    CASE airport_code WHEN '{NORTH}' THEN {_within(69.65, 18.9, 5000, '', 'zlat', 'zlon')} ELSE {_within(32.0, -117.0, 5000, '', 'zlat', 'zlon')} END AS nz FROM ends)
"""


def _oracle(body: str) -> str:
    return fx.oracle("", "points", "gates").rstrip() + ", " + _NORTHERN + body


@query("airports_legs", _oracle("SELECT airport_code, icao_hex, service_date, segment, start_ts, end_ts, points, CASE WHEN na AND nz THEN 'local' WHEN na THEN 'departure' WHEN nz THEN 'arrival' ELSE 'unknown' END AS direction FROM near_ends"))
def airports_legs(s: SparkSession, d: str) -> DataFrame:
    """Legs of two airports in one run, each by its own zone and ring."""
    p, airports, _ = two_airports(s, d)
    return sessions.flight_legs(p, C("tz"), airports).drop("registration", "callsign")


_UTIL = f"""
SELECT airport_code, service_date, gate_id, count(DISTINCT (icao_hex, session_seq)) AS sessions, CAST(sum(coalesce(lag_seconds, 0)) AS BIGINT) AS seconds FROM (
  SELECT n.*, g.gate_id FROM (
    SELECT *, CAST(sum(CASE WHEN gap IS NULL OR gap > 20 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS session_seq FROM (
      SELECT *, date_diff('minute', lag(ts) OVER w, ts) AS gap, date_diff('second', lag(ts) OVER w, ts) AS lag_seconds
      FROM near_airports WHERE altitude_baro <= 50 AND velocity <= 40 WINDOW w AS (PARTITION BY airport_code, icao_hex, service_date ORDER BY ts, event_id))
    WINDOW w AS (PARTITION BY airport_code, icao_hex, service_date ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) n
  JOIN (SELECT gate_id, lat, lon, '{fx.AIRPORT}' AS code FROM gates UNION ALL SELECT gate_id, {_moved('lat', NORTH_LAT)}, {_moved('lon', NORTH_LON)}, '{NORTH}' FROM gates) g
    ON g.code = n.airport_code AND {fx.METRES.format(a='n', b='g')} <= 120
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY {fx.METRES.format(a='n', b='g')}, g.gate_id) = 1)
GROUP BY 1, 2, 3
"""


@query("airports_gates", _oracle(_UTIL))
def airports_gates(s: SparkSession, d: str) -> DataFrame:
    """Use of the gates of two airports in one run; gate ids are an airport's own."""
    p, _, gates = two_airports(s, d)
    at = gold.gate_points(p, gates, C("tz")).where("gate_id IS NOT NULL")
    return at.groupBy("airport_code", "service_date", "gate_id").agg(F.count_distinct("icao_hex", "session_seq").alias("sessions"), F.sum(F.coalesce("lag_seconds", F.lit(0))).alias("seconds"))


@query("airports_traffic", _oracle("SELECT airport_code, service_date, count(DISTINCT icao_hex) AS aircraft, count(DISTINCT flight) AS flights, count(*) AS records FROM near_airports GROUP BY ALL"))
def airports_traffic(s: SparkSession, d: str) -> DataFrame:
    p, _, _ = two_airports(s, d)
    return gold.traffic_daily(p.withColumns({"category": F.lit("A1"), "type": F.lit("x")}), C("tz")).select("airport_code", "service_date", "aircraft", "flights", "records")
