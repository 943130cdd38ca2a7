"""Airport tables derived from the given tables by integer arithmetic, in Spark and as DuckDB SQL.

Both forms are stated side by side so that queries and their oracles see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TZ = "America/Los_Angeles"
AIRPORT = "TST"
#: Airline codes of the fixture.
AIRLINES = [("AAL", "AA", "Alpha"), ("DAL", "DL", "Delta"), ("UAL", "UA", "Union"), ("SWA", "WN", "South"), ("ASA", "AS", "North"), ("JBU", "B6", "Blue")]
RING = [(-117.01, 31.99), (-116.99, 31.99), (-116.99, 32.01), (-117.01, 32.01), (-117.01, 31.99)]
RUNWAYS = [("RWY_001", (-117.02, 32.0), (-116.98, 32.0), 400.0), ("RWY_002", (-117.0, 31.98), (-117.0, 32.02), 300.0), ("RWY_003", (-117.01, 31.99), (-116.99, 32.01), 200.0)]

_POINTS = """
SELECT event_id, user_id, sec, {start} AS ts, 'A' || lpad(CAST(user_id AS {text}), 5, '0') AS icao_hex,
  CASE WHEN user_id % 5 <> 0 THEN {code} || CAST(100 + user_id % 40 AS {text}) END AS flight,
  CASE WHEN user_id % 3 <> 0 THEN 'N' || CAST(user_id AS {text}) END AS registration,
  CASE user_id % 7 WHEN 0 THEN 'TWR' WHEN 1 THEN 'SERV' ELSE 'B738' END AS type,
  CASE user_id % 6 WHEN 0 THEN 'A1' WHEN 1 THEN 'A3' WHEN 2 THEN 'A5' WHEN 3 THEN 'A7' WHEN 4 THEN 'C2' END AS category,
  (320000 + (k * 37 + user_id * 11) % 400 - 200 + CASE WHEN grounded THEN 0 ELSE (k - 50) * 200 END) / CAST(10000 AS DOUBLE) AS lat,
  (-1170000 + (k * 53 + user_id * 17) % 400 - 200) / CAST(10000 AS DOUBLE) AS lon,
  CAST(CASE WHEN grounded THEN (k * 7 + user_id) % 45 ELSE 120 + (k * 5) % 380 END AS DOUBLE) AS velocity,
  CAST(CASE WHEN NOT grounded THEN 500 + k * 300 WHEN k % 10 = 0 THEN NULL ELSE (k * 3) % 55 END AS INT) AS altitude_baro
FROM ({base})
"""
_CODE = "CASE user_id % 6 " + " ".join(f"WHEN {i} THEN '{a[0]}'" for i, a in enumerate(AIRLINES)) + " END"
_SPARK_BASE = "SELECT *, (sec div 2400 + user_id) % 3 = 0 AS grounded FROM (SELECT event_id, user_id, timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', date_trunc('SECOND', ts)) div 48 AS sec, CAST(get_json_object(props, '$.k') AS INT) AS k FROM {events})"
_DUCK_BASE = "SELECT *, (sec // 2400 + user_id) % 3 = 0 AS grounded FROM (SELECT event_id, user_id, date_diff('second', timestamp '2024-01-01 00:00:00', date_trunc('second', ts)) // 48 AS sec, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"

_SCHEDULE = """
SELECT user_id * 10 + block AS schedule_key, {day} AS flight_date, {code} AS airline_icao, {iata} AS airline_iata,
  CAST(100 + user_id % 40 AS {text}) AS flight_number, {code} || CAST(100 + user_id % 40 AS {text}) AS flight_icao, {iata} || CAST(100 + user_id % 40 AS {text}) AS flight_iata,
  CASE WHEN user_id % 2 = 0 AND user_id % 3 <> 0 THEN 'N' || CAST(user_id AS {text}) END AS sched_registration,
  CASE WHEN (user_id + block) % 2 = 0 THEN 'TST' ELSE 'OTH' END AS dep_airport, CASE WHEN (user_id + block) % 2 = 0 THEN 'OTH' ELSE 'TST' END AS arr_airport,
  {dep} AS dep_scheduled, CASE WHEN user_id % 9 <> 0 THEN {arr} END AS arr_scheduled, CASE WHEN user_id % 4 = 0 THEN {act} END AS dep_actual,
  {name} AS airline_name, CASE WHEN user_id % 4 = 0 THEN 'active' ELSE 'scheduled' END AS flight_status,
  CASE WHEN user_id % 3 <> 0 THEN 'G' || CAST(user_id % 30 AS {text}) END AS dep_gate, 'T' || CAST(user_id % 3 AS {text}) AS dep_terminal,
  CASE WHEN user_id % 5 <> 0 THEN 'H' || CAST(user_id % 20 AS {text}) END AS arr_gate, 'T' || CAST(user_id % 4 AS {text}) AS arr_terminal,
  CASE WHEN user_id % 11 = 0 THEN 'Partner' END AS codeshare_airline, {upd} AS updated_at
FROM (SELECT DISTINCT user_id, {block} AS block FROM points WHERE flight IS NOT NULL)
"""
_IATA = "CASE user_id % 6 " + " ".join(f"WHEN {i} THEN '{a[1]}'" for i, a in enumerate(AIRLINES)) + " END"
_NAME = "CASE user_id % 6 " + " ".join(f"WHEN {i} THEN '{a[2]}'" for i, a in enumerate(AIRLINES)) + " END"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _SPARK_BASE.format(events="{events}")
    text = _POINTS.format(start="timestampadd(SECOND, sec, timestamp_ntz'2024-01-01 00:00:00')", text="STRING", code=_CODE, base=base)
    return spark.sql(text, events=_table(spark, sf_dir, "events"))


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = "timestamp_ntz'2024-01-01 00:00:00'"
    at = lambda m: f"timestampadd(MINUTE, CAST(block * 360 + {m} AS INT), {start})"
    text = _SCHEDULE.format(day=f"to_date({at('0')})", code=_CODE, iata=_IATA, text="STRING", dep=at("user_id % 90"), arr=at("user_id % 90 + 120"), act=at("user_id % 90 + user_id % 50 - 10"), name=_NAME, upd=at("user_id % 60"), block="sec div 21600")
    return spark.sql(text.replace("FROM points", "FROM {points}"), points=points(spark, sf_dir))


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS gate_id", "concat('G', s_suppkey) AS gate_name", "(319800 + (s_suppkey % 20) * 20) / CAST(10000 AS DOUBLE) AS lat", "(-1170200 + (s_suppkey div 20 % 20) * 20) / CAST(10000 AS DOUBLE) AS lon")


def airlines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(AIRLINES, "airline_icao string, airline_iata string, airline_name string")


def runways(spark: SparkSession) -> DataFrame:
    rows = [(r, [{"lon": a[0], "lat": a[1]}, {"lon": b[0], "lat": b[1]}], m) for r, a, b, m in RUNWAYS]
    return spark.createDataFrame(rows, "runway_id string, line array<struct<lon:double,lat:double>>, radius double")


def ring():
    return F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in RING])


def schedule_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flight_date, value: API payloads of the schedule, some flights twice, one text that is no JSON.

    Times of odd aircraft have no offset (airport-local), those of the others are in UTC with one.
    """
    at = lambda c: (
        f"CASE WHEN schedule_key div 10 % 2 = 0 THEN date_format({c}, \"yyyy-MM-dd'T'HH:mm:ss\") || '+00:00' "
        f"ELSE date_format(convert_timezone('UTC', '{TZ}', {c}), \"yyyy-MM-dd'T'HH:mm:ss\") END"
    )
    flight = f"""named_struct(
      'flight_status', flight_status,
      'flight', named_struct('number', flight_number, 'iata', CASE WHEN schedule_key % 3 <> 0 THEN flight_iata END, 'icao', CASE WHEN schedule_key % 4 <> 0 THEN flight_icao END,
        'codeshared', CASE WHEN codeshare_airline IS NOT NULL THEN named_struct('airline_name', codeshare_airline, 'flight_iata', 'ZZ1') END),
      'departure', named_struct('iata', dep_airport, 'scheduled', {at("dep_scheduled")}, 'actual', {at("dep_actual")}, 'terminal', dep_terminal, 'gate', dep_gate),
      'arrival', named_struct('iata', arr_airport, 'scheduled', {at("arr_scheduled")}, 'terminal', arr_terminal, 'gate', arr_gate),
      'airline', named_struct('name', airline_name, 'iata', airline_iata, 'icao', airline_icao),
      'aircraft', CASE WHEN sched_registration IS NOT NULL THEN named_struct('registration', sched_registration) END)"""
    text = f"to_json(named_struct('data', CASE WHEN schedule_key % 7 = 0 THEN array({flight}, {flight}) ELSE array({flight}) END))"
    good = schedule(spark, sf_dir).selectExpr("flight_date", f"{text} AS value", "updated_at AS ingested_at")
    return good.unionByName(good.limit(1).selectExpr("flight_date", "'{no json' AS value", "ingested_at"))


_FEATURE = """
SELECT id, kind, x, y, {point} AS feature_class, CASE kind WHEN 3 THEN 'airport' WHEN 1 THEN 'runway' ELSE 'infrastructure' END AS subtype,
  CASE WHEN id % 3 <> 0 THEN 'Name ' || CAST(id AS {text}) END AS primary_name,
  '{{"primary":' || CASE WHEN id % 3 <> 0 THEN '"Name ' || CAST(id AS {text}) || '"' ELSE 'null' END || ',"common":{{"key_value":[' ||
    CASE WHEN id % 2 = 0 THEN '{{"key":"en","value":"English ' || CAST(id AS {text}) || '"}}' ELSE '' END || ']}}}}' AS names,
  CASE WHEN id % 4 = 3 THEN NULL WHEN id % 29 = 0 THEN 'no json' ELSE '{{"key_value":[{{"key":"Ref","value":" ' || CAST(id AS {text}) || ' "}},' ||
    CASE WHEN kind = 1 AND id % 2 = 1 THEN '{{"key":"width","value":"' || CAST(id % 60 AS {text}) || '"}},' ELSE '' END ||
    '{{"key":"iata","value":"X' || CAST(id % 100 AS {text}) || '"}},{{"key":"aeroway","value":"a' || CAST(kind AS {text}) || '"}}]}}' END AS source_tags,
  CASE WHEN kind IN (0, 4, 5, 6) THEN '{{"type":"Point","coordinates":[' || {x0} || ',' || {y0} || ']}}'
       WHEN kind = 1 OR kind > 6 THEN '{{"type":"LineString","coordinates":[[' || {x0} || ',' || {y0} || '],[' || {x1} || ',' || {y0} || ']]}}'
       ELSE '{{"type":"Polygon","coordinates":[[[' || {x0} || ',' || {y0} || '],[' || {x1} || ',' || {y0} || '],[' || {x1} || ',' || {y1} || '],[' || {x0} || ',' || {y1} || '],[' || {x0} || ',' || {y0} || ']]]}}' END AS geometry
FROM (SELECT CAST(p_partkey AS BIGINT) AS id, p_partkey % 10 AS kind, -11700000 + ((p_partkey * 37) % 600 - 300) * 10 + 5 AS x, 3200000 + ((p_partkey * 53) % 600 - 300) * 10 + 5 AS y FROM {part})
"""
_CLASS = "CASE kind WHEN 0 THEN 'airport_gate' WHEN 1 THEN 'runway' WHEN 3 THEN 'international_airport' ELSE 'c' || kind END"


def _feature_sql(text: str, shown: str, part: str) -> str:
    at = {n: shown.format(v) for n, v in (("x0", "x"), ("y0", "y"), ("x1", "x + 800"), ("y1", "y + 400"))}
    return _FEATURE.format(point=_CLASS, text=text, part=part, **at)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map features from the parts: gates, runways, buildings, airports; tags and names as JSON text."""
    text = _feature_sql("STRING", "format_string('%.5f', CAST(({0}) AS DOUBLE) / 100000)", "[part]")
    text = text.replace("{", "{{").replace("}", "}}").replace("[part]", "{part}")  # braces of JSON aren't arguments
    return spark.sql(text, part=_table(spark, sf_dir, "part")).drop("kind", "x", "y")


def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").selectExpr(
        "CASE WHEN l_orderkey % 97 = 0 THEN 'bad' ELSE date_format(l_shipdate, 'MM/dd/yyyy') END AS date", "concat(l_linenumber, ':00') AS hour_of_day",
        "CASE WHEN l_orderkey % 89 = 0 THEN '-' ELSE format_number(CAST(round(l_quantity * 100) AS BIGINT), 0) END AS passengers",
        "CASE WHEN l_orderkey % 83 = 0 THEN repeat('x', 45) ELSE concat('CP', l_suppkey % 7) END AS checkpoint",
    )


def _duck_at(m: str) -> str:
    return f"timestamp '2024-01-01 00:00:00' + to_minutes(CAST(block * 360 + {m} AS INT))"


_DUCK_SCHEDULE = _SCHEDULE.format(day=f"CAST({_duck_at('0')} AS DATE)", code=_CODE, iata=_IATA, text="VARCHAR", dep=_duck_at("user_id % 90"), arr=_duck_at("user_id % 90 + 120"), act=_duck_at("user_id % 90 + user_id % 50 - 10"), name=_NAME, upd=_duck_at("user_id % 60"), block="sec // 21600")
LOCAL_DAY = f"CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE '{TZ}' AS DATE)"
METRES = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"
LABEL = "CASE category WHEN 'A7' THEN 'HELICOPTER' WHEN 'A5' THEN 'HEAVY_AIRCRAFT' WHEN 'A3' THEN 'LARGE_AIRLINER' WHEN 'A1' THEN 'LIGHT_AIRCRAFT' ELSE CASE WHEN type = 'TWR' THEN 'TOWER' WHEN type = 'SERV' THEN 'SERVICE_VEHICLE' WHEN category = 'C2' THEN 'GROUND_VEHICLE' ELSE 'OTHER' END END"
AIRCRAFT = "('HELICOPTER', 'HEAVY_AIRCRAFT', 'LARGE_AIRLINER', 'LIGHT_AIRCRAFT')"
BASE = "regexp_replace(upper(trim(flight)), '[WJXYZ]$', '')"

#: Within 5 km of the airport; the ring is a square along the axes, so that this has a closed form.
NEAR_AIRPORT = "sqrt(pow(greatest(0, abs(lat - 32.0) - 0.01), 2) + pow(greatest(0, abs(lon + 117.0) - 0.01) * cos(radians(lat)), 2)) * 6371000.0 * pi() / 180 <= 5000"

def hexagon(lat: str, lon: str, degrees: float) -> str:
    """q and r of a hexagon as two SQL columns: rounding to cube coordinates."""
    q, r = f"(({3**0.5 / 3!r} * {lon} - {lat} / 3) / {degrees})", f"(({2 / 3!r} * {lat}) / {degrees})"
    s = f"(-{q} - {r})"
    dq, dr, ds = (f"abs(round({v}) - {v})" for v in (q, r, s))
    first = f"CASE WHEN {dq} > {dr} AND {dq} > {ds} THEN -round({r}) - round({s}) ELSE round({q}) END"
    second = f"CASE WHEN {dq} > {dr} AND {dq} > {ds} THEN round({r}) WHEN {dr} > {ds} THEN -round({q}) - round({s}) ELSE round({r}) END"
    return f"CAST({first} AS BIGINT) AS q, CAST({second} AS BIGINT) AS r"


CTES = {
    "points": _POINTS.format(start="timestamp '2024-01-01 00:00:00' + to_seconds(CAST(sec AS INT))", text="VARCHAR", code=_CODE, base=_DUCK_BASE),
    "labelled": f"SELECT *, {LOCAL_DAY} AS service_date, {LABEL} AS vehicle_category FROM points",
    "ground": "SELECT * FROM labelled WHERE altitude_baro IS NOT NULL AND altitude_baro <= 50 AND velocity <= 40",
    "gapped": "SELECT *, date_diff('minute', lag(ts) OVER w, ts) AS gap, date_diff('second', lag(ts) OVER w, ts) AS lag_seconds FROM ground WINDOW w AS (PARTITION BY icao_hex, service_date ORDER BY ts, event_id)",
    "sessions": "SELECT *, CAST(sum(CASE WHEN gap IS NULL OR gap > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY icao_hex, service_date ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_seq FROM gapped",
    "gates": "SELECT s_suppkey AS gate_id, (319800 + (s_suppkey % 20) * 20) / CAST(10000 AS DOUBLE) AS lat, (-1170200 + (s_suppkey // 20 % 20) * 20) / CAST(10000 AS DOUBLE) AS lon FROM supplier",
    "near": f"SELECT * FROM (SELECT s.*, g.gate_id, {METRES.format(a='s', b='g')} AS gate_m, row_number() OVER (PARTITION BY s.event_id ORDER BY {METRES.format(a='s', b='g')} NULLS LAST, g.gate_id NULLS LAST) AS rn FROM sessions s LEFT JOIN gates g ON {METRES.format(a='s', b='g')} <= 120) WHERE rn = 1",
    "flagged": "SELECT *, (velocity <= 40 AND (altitude_baro IS NULL OR altitude_baro <= 50)) AS is_ground FROM labelled",
    "broken": "SELECT *, CASE WHEN coalesce(date_diff('minute', lag(ts) OVER w, ts), 999999) > 20 OR coalesce(lag(is_ground) OVER w <> is_ground, false) THEN 1 ELSE 0 END AS opens FROM flagged WINDOW w AS (PARTITION BY icao_hex, service_date ORDER BY ts, event_id)",
    "segmented": "SELECT *, CAST(sum(opens) OVER (PARTITION BY icao_hex, service_date ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM broken",
    "legs0": "SELECT icao_hex, service_date, segment, min(ts) AS start_ts, max(ts) AS end_ts, max(registration) AS registration, max(upper(flight)) AS callsign, count(*) AS points, arg_min(lat, (ts, event_id)) AS alat, arg_min(lon, (ts, event_id)) AS alon, arg_max(lat, (ts, event_id)) AS zlat, arg_max(lon, (ts, event_id)) AS zlon FROM segmented WHERE NOT is_ground GROUP BY ALL",
    # The ring is a square along the axes, so its distance has a closed form in the same plane.
    "legs1": "SELECT *, sqrt(pow(greatest(0, abs(alat - 32.0) - 0.01), 2) + pow(greatest(0, abs(alon + 117.0) - 0.01) * cos(radians(alat)), 2)) * 6371000.0 * pi() / 180 <= 5000 AS na, sqrt(pow(greatest(0, abs(zlat - 32.0) - 0.01), 2) + pow(greatest(0, abs(zlon + 117.0) - 0.01) * cos(radians(zlat)), 2)) * 6371000.0 * pi() / 180 <= 5000 AS nz FROM legs0",
    "legs": "SELECT icao_hex, service_date, segment, start_ts, end_ts, registration, callsign, points, CASE WHEN na AND nz THEN 'local' WHEN na THEN 'departure' WHEN nz THEN 'arrival' ELSE 'unknown' END AS direction FROM legs1",
    "schedule": _DUCK_SCHEDULE,
    "pairs": """SELECT *, 'registration_time' AS method FROM legs JOIN schedule ON registration = sched_registration AND abs(date_diff('day', flight_date, service_date)) <= 1
      UNION ALL SELECT *, 'callsign_time' FROM legs JOIN schedule ON abs(date_diff('day', flight_date, service_date)) <= 1 AND (callsign IN (flight_icao, flight_iata) OR (nullif(regexp_extract(callsign, '[0-9]+'), '') = flight_number AND nullif(regexp_extract(callsign, '^[A-Z]{2,3}'), '') IN (airline_icao, airline_iata)))""",
    "gaps": "SELECT *, CASE direction WHEN 'departure' THEN date_diff('minute', dep_scheduled, start_ts) WHEN 'arrival' THEN date_diff('minute', arr_scheduled, end_ts) ELSE CASE WHEN arr_scheduled IS NOT NULL THEN least(abs(date_diff('minute', dep_scheduled, start_ts)), abs(date_diff('minute', arr_scheduled, end_ts))) END END AS gap FROM pairs",
    "candidates": "SELECT * FROM gaps WHERE abs(gap) <= CASE WHEN method = 'registration_time' THEN 240 ELSE 2160 END",
    "scored": """SELECT *, CASE direction WHEN 'departure' THEN dep_airport = 'TST' WHEN 'arrival' THEN arr_airport = 'TST' ELSE true END AS direction_ok, abs(date_diff('day', flight_date, service_date)) AS day_diff,
      CAST(CASE WHEN method = 'registration_time' THEN greatest(0, round(100 - abs(gap) * 100 / 240)) WHEN abs(gap) <= 120 THEN round(90 - abs(gap) * 10 / 120) WHEN abs(gap) <= 1440 THEN round(79 - (abs(gap) - 120) * 19 / 1320) ELSE round(59 - (abs(gap) - 1440) * 19 / 720) END
      - 10 * abs(date_diff('day', flight_date, service_date)) - CASE WHEN direction = 'departure' AND dep_airport <> 'TST' OR direction = 'arrival' AND arr_airport <> 'TST' THEN 30 ELSE 0 END AS INT) AS score FROM candidates""",
    "results": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY icao_hex, service_date, segment ORDER BY method = 'callsign_time', direction_ok DESC NULLS FIRST, score DESC, abs(gap), day_diff, schedule_key) AS rn FROM scored) WHERE rn = 1",
    "anchors": """SELECT l.icao_hex, l.service_date, l.segment, r.schedule_key, r.method, greatest(r.score, 0) AS confidence,
      CASE l.direction WHEN 'departure' THEN l.start_ts WHEN 'arrival' THEN l.end_ts ELSE l.start_ts + to_seconds(CAST(date_diff('second', l.start_ts, l.end_ts) // 2 AS INT)) END AS anchor_ts
      FROM legs l JOIN (SELECT icao_hex, service_date, segment, schedule_key, method, score FROM results) r USING (icao_hex, service_date, segment)""",
    "keyed_legs": """SELECT nullif(regexp_extract(upper(l.callsign), '^[A-Z]{2,3}[0-9]+'), '') AS callsign_key, s.airline_icao, s.airline_iata, s.airline_name, s.dep_airport, s.arr_airport
      FROM legs l JOIN anchors r USING (icao_hex, service_date, segment) JOIN schedule s ON s.schedule_key = r.schedule_key WHERE l.callsign IS NOT NULL""",
    "prior": """SELECT a.callsign_key, airline_icao, airline_iata, airline_name, n, total_legs, origin_airport, destination_airport FROM
      (SELECT *, row_number() OVER (PARTITION BY callsign_key ORDER BY n DESC, airline_icao, airline_iata) AS rn, CAST(sum(n) OVER (PARTITION BY callsign_key) AS BIGINT) AS total_legs FROM
        (SELECT callsign_key, airline_icao, airline_iata, max(airline_name) AS airline_name, count(*) AS n FROM keyed_legs WHERE callsign_key IS NOT NULL GROUP BY ALL)) a
      LEFT JOIN (SELECT callsign_key, dep_airport AS origin_airport, arr_airport AS destination_airport FROM keyed_legs WHERE dep_airport IS NOT NULL AND arr_airport IS NOT NULL
        GROUP BY callsign_key, dep_airport, arr_airport QUALIFY row_number() OVER (PARTITION BY callsign_key ORDER BY count(*) DESC, dep_airport, arr_airport) = 1) o USING (callsign_key)
      WHERE rn = 1 AND total_legs >= 5""",
    "filled": """SELECT s.*, a.schedule_key AS own_key, a.method, a.confidence,
      last_value(a.schedule_key IGNORE NULLS) OVER b AS prev_key, last_value(a.anchor_ts IGNORE NULLS) OVER b AS prev_anchor,
      first_value(a.schedule_key IGNORE NULLS) OVER f AS next_key, first_value(a.anchor_ts IGNORE NULLS) OVER f AS next_anchor
      FROM segmented s LEFT JOIN anchors a USING (icao_hex, service_date, segment)
      WINDOW b AS (PARTITION BY icao_hex, service_date ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        f AS (PARTITION BY icao_hex, service_date ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    "keyed_points": """SELECT *, coalesce(own_key, CASE WHEN prev_key IS NULL THEN next_key WHEN next_key IS NULL THEN prev_key
      WHEN abs(date_diff('minute', prev_anchor, ts)) <= abs(date_diff('minute', next_anchor, ts)) THEN prev_key ELSE next_key END) AS schedule_key FROM filled""",
    "airlines": "SELECT * FROM (VALUES " + ", ".join(map(str, AIRLINES)) + ") AS t(airline_icao, airline_iata, airline_name)",
    "enriched": """SELECT p.event_id, p.ts, p.icao_hex, p.flight, p.registration, p.type, p.category, p.lat, p.lon, p.velocity, p.altitude_baro, p.service_date, p.vehicle_category, p.segment, p.schedule_key,
      coalesce(CASE WHEN own_key IS NOT NULL THEN s.flight_number END, nullif(trim(p.flight), '')) AS schedule_flight_number, coalesce(p.method, 'propagated') AS match_method, coalesce(p.confidence, 50) AS match_confidence,
      coalesce(s.airline_name, r.airline_name, d3.airline_name, d2.airline_name) AS airline_name, coalesce(s.airline_iata, r.airline_iata, d2.airline_iata) AS airline_iata, coalesce(s.airline_icao, r.airline_icao, d3.airline_icao) AS airline_icao,
      coalesce(s.dep_airport, r.origin_airport) AS origin_airport, coalesce(s.arr_airport, r.destination_airport) AS destination_airport, s.dep_scheduled AS scheduled_departure, s.arr_scheduled AS scheduled_arrival,
      coalesce(s.dep_airport IN ('TST', 'KTST') OR s.arr_airport IN ('TST', 'KTST'), false) AS is_local_od
      FROM keyed_points p LEFT JOIN schedule s ON s.schedule_key = p.schedule_key LEFT JOIN prior r ON r.callsign_key = nullif(regexp_extract(upper(trim(p.flight)), '^[A-Z]{2,3}[0-9]+'), '')
      LEFT JOIN airlines d3 ON d3.airline_icao = nullif(regexp_extract(upper(trim(p.flight)), '^[A-Z]{3}'), '') LEFT JOIN airlines d2 ON d2.airline_iata = nullif(regexp_extract(upper(trim(p.flight)), '^[A-Z]{2}'), '')""",
    "local": f"""SELECT * REPLACE (CASE WHEN vehicle_category IN {AIRCRAFT} THEN airline_name END AS airline_name, CASE WHEN vehicle_category IN {AIRCRAFT} THEN airline_iata END AS airline_iata, CASE WHEN vehicle_category IN {AIRCRAFT} THEN airline_icao END AS airline_icao)
      FROM (SELECT *, coalesce(flight, icao_hex) AS flight_id, bool_or(is_local_od OR {NEAR_AIRPORT}) OVER (PARTITION BY service_date, coalesce(flight, icao_hex)) AS relevant FROM enriched) WHERE relevant""",
    "gate_time": """SELECT * FROM (SELECT icao_hex, service_date, session_seq, gate_id, CAST(sum(coalesce(lag_seconds, 0)) AS BIGINT) AS seconds, count(*) AS points, max(flight) AS flight
      FROM near WHERE gate_id IS NOT NULL GROUP BY icao_hex, service_date, session_seq, gate_id)
      QUALIFY row_number() OVER (PARTITION BY icao_hex, service_date, session_seq ORDER BY seconds DESC, points DESC, gate_id) = 1""",
    "dwell": """SELECT coalesce(g.flight, p.icao_hex) AS flight_number, coalesce(a.airline_icao, a.airline_iata, d3.airline_icao, d2.airline_iata, nullif(regexp_extract(upper(g.flight), '^[A-Z]{3}'), ''), nullif(regexp_extract(upper(g.flight), '^[A-Z]{2}'), ''), 'UNK') AS airline_code,
      coalesce(a.airline_name, d3.airline_name, d2.airline_name) AS airline_name, p.service_date, p.icao_hex, p.session_seq, g.gate_id, CAST(round(p.seconds / 60.0) AS BIGINT) AS dwell_minutes, p.vehicle_category
      FROM (SELECT icao_hex, service_date, session_seq, max(vehicle_category) AS vehicle_category, sum(coalesce(lag_seconds, 0)) AS seconds FROM near WHERE gate_id IS NOT NULL GROUP BY ALL) p
      LEFT JOIN gate_time g USING (icao_hex, service_date, session_seq)
      LEFT JOIN (SELECT icao_hex, service_date, max(airline_icao) AS airline_icao, max(airline_iata) AS airline_iata, max(airline_name) AS airline_name FROM local GROUP BY ALL) a USING (icao_hex, service_date)
      LEFT JOIN airlines d3 ON d3.airline_icao = nullif(regexp_extract(upper(g.flight), '^[A-Z]{3}'), '') LEFT JOIN airlines d2 ON d2.airline_iata = nullif(regexp_extract(upper(g.flight), '^[A-Z]{2}'), '')""",
    "delays": """SELECT flight_date, airline_icao, count(*) AS flights, CAST(coalesce(sum(abs(delay)) FILTER (delay > 15), 0) AS BIGINT) AS delay_minutes, count(*) FILTER (delay > 15) AS delayed,
      CAST(coalesce(sum(abs(delay)) FILTER (delay < -15), 0) AS BIGINT) AS early_minutes, count(*) FILTER (delay < -15) AS early
      FROM (SELECT o.*, date_diff('minute', dep_scheduled, coalesce(dep_actual, (SELECT min(start_ts) FROM legs l WHERE l.direction = 'departure' AND l.service_date = o.flight_date
          AND nullif(regexp_extract(l.callsign, '[0-9]+'), '') = o.flight_number AND nullif(regexp_extract(l.callsign, '^[A-Z]{2,3}'), '') IN (o.airline_icao, o.airline_iata)))) AS delay
        FROM (SELECT * FROM schedule WHERE dep_airport = 'TST' QUALIFY row_number() OVER (PARTITION BY flight_date, flight_number, airline_iata, airline_icao ORDER BY dep_scheduled, schedule_key) = 1) o)
      WHERE delay IS NOT NULL GROUP BY flight_date, airline_icao""",
    "flight_list": f"""SELECT service_date, flight_id, count(*) AS points, min(ts) AS first_ts, max(ts) AS last_ts, bool_or(is_local_od) AS is_local_od,
      bool_or(velocity <= 40 AND (altitude_baro IS NULL OR altitude_baro <= 50) AND {NEAR_AIRPORT}) AS touched,
      unnest(arg_max({{'icao_hex': icao_hex, 'registration': registration, 'vehicle_category': vehicle_category, 'airline_name': airline_name, 'origin_airport': origin_airport, 'destination_airport': destination_airport, 'schedule_flight_number': schedule_flight_number}},
        (is_local_od, match_confidence, airline_name IS NOT NULL, origin_airport IS NOT NULL AND destination_airport IS NOT NULL, ts, event_id)))
      FROM local GROUP BY service_date, flight_id HAVING bool_or(is_local_od) OR bool_or(velocity <= 40 AND (altitude_baro IS NULL OR altitude_baro <= 50) AND {NEAR_AIRPORT})""",
    "runways": "SELECT * FROM (VALUES " + ", ".join(f"('{r}', {a[0]}, {a[1]}, {b[0]}, {b[1]}, {m})" for r, a, b, m in RUNWAYS) + ") AS t(runway_id, x0, y0, x1, y1, radius)",
    # Distance to a segment in a plane around the point, in degrees of latitude.
    "on_runways": """SELECT *, md5(icao_hex || ':' || CAST(service_date AS VARCHAR)) AS flight_key, sqrt(pow(ax + t * (bx - ax), 2) + pow(ay + t * (b_y - ay), 2)) <= radius AS inside FROM
      (SELECT *, greatest(0, least(1, -(ax * (bx - ax) + ay * (b_y - ay)) / (pow(bx - ax, 2) + pow(b_y - ay, 2)))) AS t FROM
        (SELECT p.*, r.runway_id, r.radius, (x0 - lon) * cos(radians(lat)) * 6371000.0 * pi() / 180 AS ax, (y0 - lat) * 6371000.0 * pi() / 180 AS ay, (x1 - lon) * cos(radians(lat)) * 6371000.0 * pi() / 180 AS bx, (y1 - lat) * 6371000.0 * pi() / 180 AS b_y FROM labelled p, runways r))""",
    "islands": """SELECT *, CAST(sum(CASE WHEN inside AND NOT before THEN 1 ELSE 0 END) OVER w AS BIGINT) AS event FROM
      (SELECT *, coalesce(lag(inside) OVER (PARTITION BY flight_key, runway_id ORDER BY ts, event_id), false) AS before FROM on_runways) WINDOW w AS (PARTITION BY flight_key, runway_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
    "crossings": f"""SELECT flight_key, runway_id, event, t_entry, t_exit, date_diff('second', t_entry, t_exit) AS seconds, round({METRES.format(a="c.a", b="c.z")}, 1) AS chord_m, max_speed,
      CASE WHEN z.lat - a.lat > 0.00005 THEN 'S→N' WHEN z.lat - a.lat < -0.00005 THEN 'N→S' ELSE 'uncertain' END AS direction, (a.lat + z.lat) / 2 AS mid_lat, (a.lon + z.lon) / 2 AS mid_lon FROM
      (SELECT flight_key, runway_id, event, min(ts) AS t_entry, max(ts) AS t_exit, max(velocity) AS max_speed, arg_min({{'lat': lat, 'lon': lon}}, (ts, event_id)) AS a, arg_max({{'lat': lat, 'lon': lon}}, (ts, event_id)) AS z FROM islands WHERE inside GROUP BY ALL) c""",
    # Points of the fixture lie minutes apart, so that wide limits stand for the usual ones.
    "crossing_events": """SELECT c.*, a.* EXCLUDE (flight_key), coalesce(nullif(regexp_extract(a.flight_number, '^[A-Z]{3}'), ''), 'UNK') AS airline_code FROM crossings c
      JOIN (SELECT md5(icao_hex || ':' || CAST(service_date AS VARCHAR)) AS flight_key, icao_hex, service_date, arg_min(flight, (ts, event_id)) FILTER (flight IS NOT NULL) AS flight_number FROM labelled GROUP BY ALL) a USING (flight_key)
      WHERE max_speed <= 80 AND seconds <= 7200 AND chord_m <= 5000 AND direction <> 'uncertain'""",
    "features": _feature_sql("VARCHAR", "printf('%.5f', CAST(({0}) AS DOUBLE) / 100000)", "part"),
    "tsa": "SELECT try_strptime(CASE WHEN l_orderkey % 97 = 0 THEN 'bad' ELSE strftime(l_shipdate, '%m/%d/%Y') END, '%m/%d/%Y') AS d, l_linenumber AS h, CASE WHEN l_orderkey % 89 <> 0 THEN CAST(round(l_quantity * 100) AS BIGINT) END AS pax, CASE WHEN l_orderkey % 83 = 0 THEN NULL ELSE 'CP' || CAST(l_suppkey % 7 AS VARCHAR) END AS checkpoint FROM lineitem",
}
_NEEDS = {"points": [], "labelled": ["points"], "ground": ["labelled"], "gapped": ["ground"], "sessions": ["gapped"], "gates": [], "near": ["sessions", "gates"], "flagged": ["labelled"], "broken": ["flagged"], "segmented": ["broken"], "legs0": ["segmented"], "legs1": ["legs0"], "legs": ["legs1"], "schedule": ["points"], "pairs": ["legs", "schedule"], "gaps": ["pairs"], "candidates": ["gaps"], "scored": ["candidates"], "results": ["scored"], "tsa": [],
          "anchors": ["legs", "results"], "keyed_legs": ["anchors", "schedule"], "prior": ["keyed_legs"], "filled": ["segmented", "anchors"], "keyed_points": ["filled"], "airlines": [],
          "enriched": ["keyed_points", "prior", "airlines"], "local": ["enriched"], "gate_time": ["near"], "dwell": ["gate_time", "local", "airlines"], "features": [],
          "delays": ["schedule", "legs"], "flight_list": ["local"], "runways": [], "on_runways": ["labelled", "runways"], "islands": ["on_runways"], "crossings": ["islands"], "crossing_events": ["crossings"]}


def oracle(body: str, *tables: str) -> str:
    """SQL of an oracle: the fixture tables it needs, then ``body``."""
    needed: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS[name]:
            add(n)
        if name not in needed:
            needed.append(name)

    for t in tables:
        add(t)
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in needed) + " " + body
