"""Queries of the schedule, the enriched points and the airport's map features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airside import queries as base
from airside.functions import flight as fl
from airside.functions import geo
from airside.operators import aircraft, enrichment, gold, infrastructure, matching, schedules, spatial
from airside.plans import fixtures as fx
from airside.registry import query
from airside.sources.files import stored

C = F.col
CODES = [fx.AIRPORT, "KTST"]
AS_OF = "2024-01-01 14:30:00"

# --- schedule -------------------------------------------------------------------------------
_PARSED = """SELECT flight_date, flight_status, dep_airport, dep_scheduled, dep_actual, dep_terminal, dep_gate, arr_airport, arr_scheduled, arr_terminal, arr_gate,
  airline_name, airline_iata, airline_icao, flight_number, flight_iata, flight_icao, sched_registration, codeshare_airline, updated_at
FROM schedule QUALIFY row_number() OVER (PARTITION BY flight_iata, dep_scheduled
  ORDER BY updated_at DESC, arr_scheduled DESC NULLS LAST, sched_registration DESC NULLS LAST, flight_icao NULLS LAST) = 1"""
_SCHEDULE_COLUMNS = [
    "flight_date", "flight_status", "dep_airport", "dep_scheduled", "dep_actual", "dep_terminal", "dep_gate", "arr_airport", "arr_scheduled", "arr_terminal", "arr_gate",
    "airline_name", "airline_iata", "airline_icao", "flight_number", "flight_iata", "flight_icao", "sched_registration", "codeshare_airline", "updated_at",
]


def _parsed(s: SparkSession, d: str) -> DataFrame:
    return schedules.schedule_parse(fx.schedule_payloads(s, d), fx.TZ)


@query("schedule_parse", _PARSED, "schedule")
def schedule_parse(s: SparkSession, d: str) -> DataFrame:
    return _parsed(s, d).select(*_SCHEDULE_COLUMNS)


_TARGET = ["flight_key", "flight_date", "flight_status", "dep_scheduled", "dep_actual", "arr_scheduled", "airline_icao", "flight_number", "flight_iata", "sched_registration", "is_codeshare", "updated_at"]
_KEY = "md5(coalesce(flight_iata, 'UNKNOWN') || ':' || coalesce(strftime(dep_scheduled, '%Y-%m-%d %H:%M:%S'), 'UNKNOWN') || ':' || coalesce(strftime(arr_scheduled, '%Y-%m-%d %H:%M:%S'), 'UNKNOWN'))"


@query(
    "schedule_etl_upsert",
    f"""SELECT {_KEY} AS flight_key, flight_date, CASE WHEN h % 3 = 0 THEN 'landed' ELSE flight_status END AS flight_status, dep_scheduled, dep_actual, arr_scheduled,
      airline_icao, CASE WHEN h % 2 = 0 OR h % 3 <> 0 THEN flight_number ELSE 'new' END AS flight_number, flight_iata, sched_registration, codeshare_airline IS NOT NULL AS is_codeshare,
      CASE WHEN h % 3 = 0 THEN updated_at + INTERVAL 1 DAY ELSE updated_at END AS updated_at
    FROM (SELECT *, CAST('0x' || substr({_KEY}, 1, 4) AS BIGINT) AS h FROM ({_PARSED})) WHERE h % 2 = 0 OR h % 3 = 0""",
    "schedule",
)
def schedule_etl_upsert(s: SparkSession, d: str) -> DataFrame:
    """A target of half the flights, a later batch of a third with changed status and number."""
    key = schedules.schedule_key(C("flight_iata"), C("dep_scheduled"), C("arr_scheduled"))
    rows = _parsed(s, d).withColumn("flight_key", key).withColumn("is_codeshare", schedules.is_codeshare(C("codeshare_airline")))
    rows = rows.withColumn("h", F.conv(F.substring("flight_key", 1, 4), 16, 10).cast("long"))
    target = rows.where("h % 2 = 0").select(*_TARGET)
    batch = rows.where("h % 3 = 0").withColumns({"flight_status": F.lit("landed"), "flight_number": F.lit("new"), "updated_at": C("updated_at") + F.expr("INTERVAL 1 DAY")})
    return schedules.schedule_etl_upsert(target, batch)


@query("schedule_codeshare_flag", "SELECT schedule_key, codeshare_airline IS NOT NULL AS is_codeshare FROM schedule", "schedule")
def schedule_codeshare_flag(s: SparkSession, d: str) -> DataFrame:
    return fx.schedule(s, d).select("schedule_key", schedules.is_codeshare(C("codeshare_airline")).alias("is_codeshare"))


@query("planned_gate", "SELECT schedule_key, CASE WHEN dep_airport = 'TST' THEN dep_gate ELSE arr_gate END AS planned_gate, CASE WHEN dep_airport = 'TST' THEN dep_terminal ELSE arr_terminal END AS planned_terminal FROM schedule", "schedule")
def planned_gate(s: SparkSession, d: str) -> DataFrame:
    direction = fl.schedule_direction(C("dep_airport"), C("arr_airport"), CODES)
    return fx.schedule(s, d).select("schedule_key", fl.planned(direction, C("dep_gate"), C("arr_gate")).alias("planned_gate"), fl.planned(direction, C("dep_terminal"), C("arr_terminal")).alias("planned_terminal"))


@query(
    "code_translation_join",
    """SELECT event_id, prefix, CASE length(prefix) WHEN 3 THEN a.airline_iata WHEN 2 THEN b.airline_icao END AS other_code
    FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN nullif(regexp_extract(flight, '^[A-Z]{3}'), '') ELSE (CASE substr(flight, 1, 3) WHEN 'AAL' THEN 'AA' WHEN 'DAL' THEN 'DL' ELSE 'XX' END) END AS prefix FROM points WHERE flight IS NOT NULL)
    LEFT JOIN airlines a ON prefix = a.airline_icao LEFT JOIN airlines b ON prefix = b.airline_iata""",
    "points", "airlines",
)
def code_translation_join(s: SparkSession, d: str) -> DataFrame:
    short = F.when(C("flight").startswith("AAL"), "AA").when(C("flight").startswith("DAL"), "DL").otherwise("XX")
    prefix = F.when(C("event_id") % 2 == 0, fl.callsign_prefix(C("flight"))).otherwise(short)
    rows = fx.points(s, d).where("flight IS NOT NULL").select("event_id", prefix.alias("prefix"))
    return schedules.code_translation_join(rows, fx.airlines(s)).select("event_id", "prefix", "other_code")


_IDS = "SELECT DISTINCT flight AS flight_id, service_date AS on_date FROM labelled WHERE flight IS NOT NULL"
_NUMBER = "nullif(regexp_extract(flight_id, '[0-9]+'), '')"
_PREFIX = "nullif(regexp_extract(flight_id, '^[A-Z]{2,3}'), '')"
_BEST = """SELECT {columns} FROM (SELECT i.flight_id, i.on_date, s.*, CASE WHEN flight_icao = flight_id THEN 0 WHEN flight_iata = flight_id THEN 1 ELSE 2 END AS match_rank, abs(date_diff('day', flight_date, on_date)) AS date_diff
  FROM ({ids}) i JOIN schedule s ON abs(date_diff('day', flight_date, on_date)) <= 1 AND ({how}))
  QUALIFY row_number() OVER (PARTITION BY flight_id, on_date ORDER BY match_rank, date_diff, updated_at DESC, schedule_key) = 1"""
_EXACT = "flight_icao = flight_id OR flight_iata = flight_id"
_LOOSE = f"{_EXACT} OR (flight_number = {_NUMBER} AND ((length({_PREFIX}) = 3 AND airline_icao = {_PREFIX}) OR (length({_PREFIX}) = 2 AND airline_iata = {_PREFIX})))"


def _ids(s: SparkSession, d: str) -> DataFrame:
    from airside.functions.time import service_date

    return fx.points(s, d).where("flight IS NOT NULL").select(C("flight").alias("flight_id"), service_date(C("ts"), fx.TZ).alias("on_date")).distinct()


@query("schedule_for_flight", _BEST.format(columns="flight_id, on_date, schedule_key, match_rank, date_diff", ids=_IDS, how=_LOOSE), "labelled", "schedule")
def schedule_for_flight(s: SparkSession, d: str) -> DataFrame:
    return schedules.schedule_for_flight(_ids(s, d), fx.schedule(s, d)).select("flight_id", "on_date", "schedule_key", "match_rank", "date_diff")


@query("flight_headers", _BEST.format(columns="flight_id, on_date, airline_name, dep_airport AS origin_airport, arr_airport AS destination_airport, flight_number AS schedule_flight_number", ids=_IDS, how=_EXACT), "labelled", "schedule")
def flight_headers(s: SparkSession, d: str) -> DataFrame:
    return schedules.flight_headers(_ids(s, d), fx.schedule(s, d))


@query("schedule_info", "SELECT *, CASE WHEN dep_airport IN ('TST', 'KTST') THEN 'departure' WHEN arr_airport IN ('TST', 'KTST') THEN 'arrival' ELSE 'unknown' END AS direction FROM (" + _BEST.format(columns="flight_id, schedule_key, flight_status, dep_airport, arr_airport, dep_scheduled, arr_scheduled, dep_actual", ids="SELECT * FROM (" + _IDS + ") WHERE flight_id LIKE 'AAL1%'", how=_LOOSE) + ")", "labelled", "schedule")
def schedule_info(s: SparkSession, d: str) -> DataFrame:
    best = schedules.schedule_for_flight(_ids(s, d).where("flight_id LIKE 'AAL1%'"), fx.schedule(s, d))
    return best.select("flight_id", "schedule_key", "flight_status", "dep_airport", "arr_airport", "dep_scheduled", "arr_scheduled", "dep_actual", fl.schedule_direction(C("dep_airport"), C("arr_airport"), CODES).alias("direction"))


_NAMES = """SELECT code, coalesce(max(own), max(other)) AS airline_name FROM (
  SELECT unnest([airline_icao, airline_iata]) AS code, CASE WHEN schedule_key % 2 = 0 AND airline_icao <> 'AAL' THEN airline_name END AS own, NULL AS other FROM schedule
  UNION ALL SELECT unnest([airline_icao, airline_iata]), NULL, airline_name || ' Air' FROM airlines) GROUP BY code"""


@query("airline_name_map", _NAMES, "schedule", "airlines")
def airline_name_map(s: SparkSession, d: str) -> DataFrame:
    """One airline, and every other flight, has no name in the schedule."""
    dim = fx.airlines(s).withColumn("airline_name", F.concat("airline_name", F.lit(" Air")))
    named = F.when((C("schedule_key") % 2 == 0) & (C("airline_icao") != "AAL"), C("airline_name"))
    return schedules.airline_name_map(fx.schedule(s, d).withColumn("airline_name", named), dim)


@query("airline_display_name", "SELECT schedule_key, CASE WHEN schedule_key % 3 = 0 THEN 'Some Long Name' WHEN schedule_key % 5 = 0 THEN 'ZZZ' ELSE airline_name END AS airline_name FROM schedule", "schedule")
def airline_display_name(s: SparkSession, d: str) -> DataFrame:
    code = F.when(C("schedule_key") % 3 == 0, "some long name").when(C("schedule_key") % 5 == 0, "ZZZ").otherwise(C("airline_icao"))
    rows = fx.schedule(s, d).select("schedule_key", code.alias("code"))
    names = fx.airlines(s).select(C("airline_icao").alias("code"), "airline_name")
    return rows.join(F.broadcast(names), "code", "left").select("schedule_key", fl.display_name(C("code"), C("airline_name")).alias("airline_name"))


# --- enriched points -------------------------------------------------------------------------
def enriched(s: SparkSession, d: str) -> DataFrame:
    legs, results = base.matched(s, d)
    flights = fx.schedule(s, d)
    prior = matching.callsign_prior(legs, results, flights, 5)
    prior = stored(prior, "prior")
    return enrichment.enrich_points(fx.points(s, d), legs, results, flights, prior, fx.airlines(s), fx.TZ, CODES)


def local(s: SparkSession, d: str) -> DataFrame:
    return enrichment.adsb_local(stored(enriched(s, d), "enriched"), fx.ring())


def dwell(s: SparkSession, d: str) -> DataFrame:
    at_gates = stored(base._at_gates(s, d), "at-gates")
    return enrichment.flight_dwell_with_airline(at_gates, gold.flight_gate_time(at_gates), local(s, d), fx.airlines(s))


_ENRICHED = ["event_id", "schedule_key", "schedule_flight_number", "match_method", "match_confidence", "airline_name", "airline_iata", "airline_icao", "origin_airport", "destination_airport", "scheduled_departure", "scheduled_arrival", "is_local_od"]


@query("enrich_points", f"SELECT {', '.join(_ENRICHED)} FROM enriched", "enriched")
def enrich_points(s: SparkSession, d: str) -> DataFrame:
    return enriched(s, d).select(*_ENRICHED)


@query("as_of_nearest_match", "SELECT event_id, prev_key, next_key, schedule_key FROM keyed_points", "keyed_points")
def as_of_nearest_match(s: SparkSession, d: str) -> DataFrame:
    """The choice between the matched legs before and after each point."""
    from airside.operators.sessions import segments

    found = enrichment.anchors(*base.matched(s, d))
    return enrichment.nearest_anchor(segments(fx.points(s, d), fx.TZ), found).select("event_id", "prev_key", "next_key", "schedule_key")


@query("adsb_local", "SELECT event_id, service_date, flight_id, vehicle_category, airline_name, airline_iata, airline_icao, is_local_od FROM local", "local")
def adsb_local(s: SparkSession, d: str) -> DataFrame:
    return local(s, d).select("event_id", "service_date", "flight_id", "vehicle_category", "airline_name", "airline_iata", "airline_icao", "is_local_od")


@query("semi_join", "SELECT event_id FROM labelled SEMI JOIN (SELECT DISTINCT icao_hex, service_date FROM ground) USING (icao_hex, service_date)", "ground")
def semi_join(s: SparkSession, d: str) -> DataFrame:
    """Points of the aircraft-days that have a point on the ground."""
    from airside.functions.time import service_date

    p = fx.points(s, d).withColumn("service_date", service_date(C("ts"), fx.TZ))
    ground = p.where(fl.is_ground_gate(C("velocity"), C("altitude_baro"))).select("icao_hex", "service_date").distinct()
    return p.join(ground, ["icao_hex", "service_date"], "left_semi").select("event_id")


@query("flight_dwell_with_airline", "SELECT flight_number, airline_code, airline_name, service_date, icao_hex, session_seq, gate_id, dwell_minutes, vehicle_category FROM dwell", "dwell")
def flight_dwell_with_airline(s: SparkSession, d: str) -> DataFrame:
    return dwell(s, d)


@query("top_dwell_flights", "SELECT flight_number, airline_code, airline_name, service_date, gate_id, dwell_minutes FROM dwell ORDER BY dwell_minutes DESC, flight_number, service_date, icao_hex, session_seq LIMIT 20", "dwell")
def top_dwell_flights(s: SparkSession, d: str) -> DataFrame:
    order = [C("dwell_minutes").desc(), "flight_number", "service_date", "icao_hex", "session_seq"]
    return dwell(s, d).orderBy(*order).limit(20).select("flight_number", "airline_code", "airline_name", "service_date", "gate_id", "dwell_minutes")


_TIMETABLE = f"""
SELECT l.flight, l.icao_hex, l.registration, l.ts AS last_seen, l.lat, l.lon, l.altitude_baro, l.velocity, CASE WHEN b.dep_airport = 'TST' THEN 'departure' WHEN b.arr_airport = 'TST' THEN 'arrival' END AS direction,
  coalesce(b.airline_name, d3.airline_name, d2.airline_name) AS airline_name, b.schedule_key, b.dep_airport, b.arr_airport, b.dep_scheduled, b.arr_scheduled, b.flight_status,
  CASE WHEN b.dep_airport = 'TST' THEN b.dep_gate WHEN b.arr_airport = 'TST' THEN b.arr_gate END AS planned_gate, CASE WHEN b.dep_airport = 'TST' THEN b.dep_terminal WHEN b.arr_airport = 'TST' THEN b.arr_terminal END AS planned_terminal,
  n.gate_id AS nearest_gate, round(n.m, 1) AS nearest_gate_m, g.gate_id AS actual_gate, g.seconds AS actual_gate_seconds
FROM (SELECT * FROM local WHERE flight IS NOT NULL AND ts <= timestamp '{AS_OF}' AND ts >= timestamp '{AS_OF}' - INTERVAL 60 MINUTE
  QUALIFY row_number() OVER (PARTITION BY flight ORDER BY ts DESC, event_id DESC) = 1) l
LEFT JOIN (SELECT * FROM (SELECT i.flight AS flight_id, s.*, CASE WHEN flight_icao = i.flight THEN 0 WHEN flight_iata = i.flight THEN 1 ELSE 2 END AS rank
    FROM (SELECT DISTINCT flight FROM points WHERE flight IS NOT NULL) i JOIN schedule s ON abs(date_diff('day', flight_date, DATE '2024-01-01')) <= 1
      AND (flight_icao = i.flight OR flight_iata = i.flight OR (flight_number = regexp_extract(i.flight, '[0-9]+') AND airline_icao = regexp_extract(i.flight, '^[A-Z]{{2,3}}'))))
  QUALIFY row_number() OVER (PARTITION BY flight_id ORDER BY rank, abs(date_diff('day', flight_date, DATE '2024-01-01')), updated_at DESC, schedule_key) = 1) b ON b.flight_id = l.flight
LEFT JOIN (SELECT * FROM (SELECT p.event_id, gates.gate_id, {fx.METRES.format(a="p", b="gates")} AS m FROM local p JOIN gates ON {fx.METRES.format(a="p", b="gates")} <= 300 WHERE p.ts >= timestamp '{AS_OF}' - INTERVAL 60 MINUTE)
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY m, gate_id) = 1) n ON n.event_id = l.event_id
LEFT JOIN (SELECT * FROM gate_time WHERE flight IS NOT NULL QUALIFY row_number() OVER (PARTITION BY flight ORDER BY service_date DESC, seconds DESC, icao_hex, session_seq) = 1) g ON g.flight = l.flight
LEFT JOIN airlines d3 ON d3.airline_icao = regexp_extract(l.flight, '^[A-Z]{{3}}') LEFT JOIN airlines d2 ON d2.airline_iata = regexp_extract(l.flight, '^[A-Z]{{2}}')"""


@query("live_timetable", _TIMETABLE, "local", "gate_time", "gates", "airlines", "schedule")
def live_timetable(s: SparkSession, d: str) -> DataFrame:
    gate_time = stored(gold.flight_gate_time(base._at_gates(s, d)), "gate-time")
    return enrichment.live_timetable(local(s, d), fx.schedule(s, d), fx.gates(s, d), gate_time, fx.airlines(s), AS_OF, CODES, 60)


# --- aircraft dimension ------------------------------------------------------------------------
_META = "SELECT icao_hex, CASE WHEN user_id % 2 = 0 THEN type END AS type, CASE WHEN user_id % 3 = 0 THEN 'Jet ' || user_id END AS aircraft_desc, registration, timestamp '2024-01-01 00:00:00' + to_hours(CAST(user_id % 24 AS INT)) AS updated_at FROM (SELECT DISTINCT icao_hex, user_id, type, registration FROM points WHERE user_id % 4 <> 0)"


def _meta(s: SparkSession, d: str) -> DataFrame:
    rows = fx.points(s, d).where("user_id % 4 <> 0").select("icao_hex", "user_id", "type", "registration").distinct()
    return rows.selectExpr("icao_hex", "CASE WHEN user_id % 2 = 0 THEN type END AS type", "CASE WHEN user_id % 3 = 0 THEN 'Jet ' || user_id END AS aircraft_desc", "registration", "timestampadd(HOUR, CAST(user_id % 24 AS INT), timestamp_ntz'2024-01-01 00:00:00') AS updated_at")


@query(
    "aircraft_meta_candidates",
    f"""SELECT p.icao_hex FROM (SELECT DISTINCT icao_hex FROM points WHERE ts >= timestamp '2024-01-01 09:00:00') p LEFT JOIN ({_META}) m USING (icao_hex)
    WHERE (m.type IS NULL OR m.aircraft_desc IS NULL) AND (m.updated_at IS NULL OR m.updated_at < timestamp '2024-01-01 09:00:00') ORDER BY 1 LIMIT 200""",
    "points",
)
def aircraft_meta_candidates(s: SparkSession, d: str) -> DataFrame:
    return aircraft.meta_candidates(fx.points(s, d), _meta(s, d), "2024-01-01 15:00:00", seen_hours=6, fresh_hours=6)


@query(
    "aircraft_meta_upsert",
    f"""SELECT coalesce(b.icao_hex, t.icao_hex) AS icao_hex, coalesce(b.type, t.type) AS type, coalesce(b.aircraft_desc, t.aircraft_desc) AS aircraft_desc, coalesce(b.registration, t.registration) AS registration, coalesce(b.updated_at, t.updated_at) AS updated_at
    FROM ({_META}) t FULL JOIN (SELECT DISTINCT icao_hex, CASE WHEN user_id % 5 = 0 THEN 'NEW' END AS type, CASE WHEN user_id % 7 = 0 THEN 'New ' || user_id END AS aircraft_desc, CAST(NULL AS VARCHAR) AS registration, timestamp '2024-01-02 00:00:00' AS updated_at FROM points WHERE user_id % 3 <> 1) b USING (icao_hex)""",
    "points",
)
def aircraft_meta_upsert(s: SparkSession, d: str) -> DataFrame:
    batch = fx.points(s, d).where("user_id % 3 <> 1").selectExpr("icao_hex", "CASE WHEN user_id % 5 = 0 THEN 'NEW' END AS type", "CASE WHEN user_id % 7 = 0 THEN 'New ' || user_id END AS aircraft_desc", "CAST(NULL AS STRING) AS registration", "timestamp_ntz'2024-01-02 00:00:00' AS updated_at")
    return aircraft.meta_upsert(_meta(s, d), batch)


@query(
    "aircraft_desc_backfill",
    f"SELECT event_id, coalesce(nullif(trim(p.type), ''), m.type) AS type, m.aircraft_desc, coalesce(p.registration, m.registration) AS registration FROM (SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN ' ' ELSE type END AS type) FROM points) p LEFT JOIN ({_META}) m USING (icao_hex)",
    "points",
)
def aircraft_desc_backfill(s: SparkSession, d: str) -> DataFrame:
    p = fx.points(s, d).withColumn("type", F.when(C("event_id") % 3 == 0, " ").otherwise(C("type"))).withColumn("aircraft_desc", F.lit(None).cast("string"))
    return aircraft.desc_backfill(p, _meta(s, d)).select("event_id", "type", "aircraft_desc", "registration")


# --- map features --------------------------------------------------------------------------------
_REF = "CASE WHEN id % 4 <> 3 AND id % 29 <> 0 THEN CAST(id AS VARCHAR) END"
_TAGGED = "id % 4 <> 3 AND id % 29 <> 0"
_WIDE = "CASE WHEN kind IN (0, 4, 5, 6) THEN 0 ELSE 800 END"
_HIGH = "CASE WHEN kind IN (2, 3) THEN 400 ELSE 0 END"
#: Boxes and lines along the axes meet the square ring if their extents do.
_MEETS = f"x <= -11699000 AND x + {_WIDE} >= -11701000 AND y <= 3201000 AND y + {_HIGH} >= 3199000"


@query("tag_lookup", f"SELECT id, {_REF} AS ref, CASE WHEN {_TAGGED} THEN 'X' || CAST(id % 100 AS VARCHAR) END AS iata FROM features", "features")
def tag_lookup(s: SparkSession, d: str) -> DataFrame:
    t = infrastructure.tag_list(C("source_tags"))
    return fx.features(s, d).select("id", infrastructure.tag_lookup(t, "REF").alias("ref"), infrastructure.tag_lookup(t, *infrastructure.IATA_TAGS).alias("iata"))


@query("conditional_pivot", f"SELECT id, CASE WHEN {_TAGGED} THEN 'a' || kind END AS tag_aeroway, {_REF} AS tag_ref, CASE WHEN {_TAGGED} AND kind = 1 AND id % 2 = 1 THEN CAST(id % 60 AS VARCHAR) END AS tag_width FROM features", "features")
def conditional_pivot(s: SparkSession, d: str) -> DataFrame:
    return infrastructure.tag_pivot(fx.features(s, d), ["aeroway", "ref", "width"])


@query("geojson_parse", f"SELECT id, CASE WHEN kind IN (0, 4, 5, 6) THEN 'Point' WHEN kind IN (2, 3) THEN 'Polygon' ELSE 'LineString' END AS geometry_type, CASE WHEN kind IN (0, 4, 5, 6) THEN 1 WHEN kind IN (2, 3) THEN 5 ELSE 2 END AS vertices, x / 100000.0 AS lon, y / 100000.0 AS lat FROM features", "features")
def geojson_parse(s: SparkSession, d: str) -> DataFrame:
    rows = fx.features(s, d).withColumn("v", geo.geojson_vertices(C("geometry")))
    return rows.select("id", geo.geojson_type(C("geometry")).alias("geometry_type"), F.size("v").alias("vertices"), C("v")[0]["lon"].alias("lon"), C("v")[0]["lat"].alias("lat"))


@query("geojson_polygons", "SELECT id, unnest(CASE WHEN id % 2 = 0 THEN [x] ELSE [x, x + 800] END) / 100000.0 AS lon FROM features WHERE kind IN (2, 3)", "features")
def geojson_polygons(s: SparkSession, d: str) -> DataFrame:
    """Parts of polygons, and of multipolygons put together from a ring and the same ring from its second vertex on."""
    ring = F.get_json_object("geometry", "$.coordinates[0]")
    turned = F.concat(F.lit("["), F.regexp_replace(ring, r"^\[\[[^\]]*\],", ""))
    both = F.concat(F.lit('{"type":"MultiPolygon","coordinates":[['), ring, F.lit("],["), turned, F.lit("]]}"))
    rows = fx.features(s, d).withColumn("g", F.when(C("id") % 2 == 0, C("geometry")).when(geo.geojson_type(C("geometry")) == "Polygon", both))
    parts = rows.select("id", F.explode(geo.geojson_polygons(C("g"))).alias("ring"))
    return parts.select("id", C("ring")[0]["lon"].alias("lon"))


@query("st_intersects_feature", f"SELECT id, {_MEETS} AS meets FROM features", "features")
def st_intersects_feature(s: SparkSession, d: str) -> DataFrame:
    rows = fx.features(s, d).withColumn("v", geo.geojson_vertices(C("geometry")))
    return rows.select("id", geo.intersects_ring(C("v"), geo.geojson_type(C("geometry")) == "Polygon", fx.ring()).alias("meets"))


@query("bbox_centroid", "SELECT id AS airport_id, x / 100000.0 AS min_lon, y / 100000.0 AS min_lat, (x + 800) / 100000.0 AS max_lon, (y + 400) / 100000.0 AS max_lat, round((x + 400) / 100000.0, 6) AS center_lon, round((y + 200) / 100000.0, 6) AS center_lat FROM features WHERE kind IN (2, 3)", "features")
def bbox_centroid(s: SparkSession, d: str) -> DataFrame:
    found = infrastructure.airport_properties(fx.features(s, d))
    return found.withColumn("center_lon", F.round("center_lon", 6)).withColumn("center_lat", F.round("center_lat", 6))


@query("airport_properties", "SELECT id AS airport_id, y / 100000.0 AS min_lat, (y + 400) / 100000.0 AS max_lat, round((x + 400) / 100000.0, 6) AS center_lon, 'America/Los_Angeles' AS airport_tzid FROM features WHERE kind = 3", "features")
def airport_properties(s: SparkSession, d: str) -> DataFrame:
    found = infrastructure.airport_properties(fx.features(s, d).where(C("feature_class").isin(infrastructure.AIRPORT_CLASSES)))
    return found.select("airport_id", "min_lat", "max_lat", F.round("center_lon", 6).alias("center_lon"), F.lit(fx.TZ).alias("airport_tzid"))


@query("airport_inventory", f"SELECT id AS airport_id, coalesce(CASE WHEN id % 2 = 0 THEN 'English ' || id END, primary_name) AS airport_name, CASE WHEN {_TAGGED} THEN 'X' || (id % 100) ELSE '' END AS airport_iata, '' AS airport_icao FROM features WHERE kind = 3 AND (id % 2 = 0 OR primary_name IS NOT NULL) ORDER BY 2, 1 LIMIT 5000", "features")
def airport_inventory(s: SparkSession, d: str) -> DataFrame:
    return infrastructure.airport_inventory(fx.features(s, d))


_INFRA = f"""SELECT id, feature_class, subtype, primary_name, CASE WHEN kind IN (0, 4, 5, 6) THEN 'Point' WHEN kind IN (2, 3) THEN 'Polygon' ELSE 'LineString' END AS geometry_type,
  CASE WHEN {_TAGGED} THEN 'a' || kind END AS tag_aeroway, {_REF} AS tag_ref, CASE WHEN {_TAGGED} AND kind = 1 AND id % 2 = 1 THEN CAST(id % 60 AS DOUBLE) END AS tag_width FROM features WHERE {_MEETS}"""


@query("infrastructure", _INFRA, "features")
def infrastructure_query(s: SparkSession, d: str) -> DataFrame:
    found = infrastructure.infrastructure(fx.features(s, d), fx.ring())
    return found.select("id", "feature_class", "subtype", "primary_name", "geometry_type", "tag_aeroway", "tag_ref", "tag_width")


@query("infrastructure_types", f"SELECT feature_class, subtype, count(*) AS features FROM ({_INFRA}) GROUP BY ALL", "features")
def infrastructure_types(s: SparkSession, d: str) -> DataFrame:
    return infrastructure.infrastructure_types(infrastructure.infrastructure(fx.features(s, d), fx.ring()))


@query("infrastructure_layers", f"SELECT id, feature_class, coalesce(tag_ref, primary_name) AS label FROM ({_INFRA}) WHERE feature_class IN ('airport_gate', 'c2')", "features")
def infrastructure_layers(s: SparkSession, d: str) -> DataFrame:
    return infrastructure.infrastructure_layers(infrastructure.infrastructure(fx.features(s, d), fx.ring()), ["airport_gate", "c2"])


_SQUARE_M = "sqrt(pow(greatest(0, abs(y / 100000.0 - 32.0) - 0.01), 2) + pow(greatest(0, abs(x / 100000.0 + 117.0) - 0.01) * cos(radians(y / 100000.0)), 2)) * 6371000.0 * pi() / 180"


@query("gates", f"SELECT id AS gate_id, coalesce(primary_name, {_REF}, CAST(id AS VARCHAR)) AS gate_name, x / 100000.0 AS lon, y / 100000.0 AS lat FROM features WHERE kind = 0 AND {_SQUARE_M} <= 2000", "features")
def gates(s: SparkSession, d: str) -> DataFrame:
    return infrastructure.gates(fx.features(s, d), fx.ring())


def _corridors(s: SparkSession, d: str) -> DataFrame:
    found = stored(infrastructure.runways(fx.features(s, d), fx.ring()), "runways")
    return infrastructure.runway_corridors(found.withColumn("airport_code", F.lit(fx.AIRPORT)))


#: Runways of the fixture run from west to east; two overlap if the gap between them is at most both radii.
_OVERLAPS = """
WITH RECURSIVE spots AS (
  SELECT CAST(p_partkey AS BIGINT) AS id, CAST(-11700000 + ((p_partkey * 37) % 600 - 300) * 10 + 5 AS BIGINT) AS x,
    CAST(3200000 + ((p_partkey * 53) % 600 - 300) * 10 + 5 AS BIGINT) AS y FROM part WHERE p_partkey % 10 = 1),
corridors AS MATERIALIZED (
  SELECT id, x / CAST(100000 AS DOUBLE) AS x0, (x + 800) / CAST(100000 AS DOUBLE) AS x1, y / CAST(100000 AS DOUBLE) AS lat,
    CASE WHEN id % 4 = 3 OR id % 29 = 0 THEN CAST(30 AS DOUBLE) ELSE (id % 60) / CAST(2 AS DOUBLE) END AS radius
  FROM spots WHERE y BETWEEN 3199000 AND 3201000 AND x + 800 >= -11701000 AND x <= -11699000),
gaps AS (
  SELECT a.id AS a, b.id AS b, a.radius + b.radius AS reach, (a.lat - b.lat) * {metre} AS dy,
    greatest(0, greatest(a.x0, b.x0) - least(a.x1, b.x1)) * least(cos(radians(a.lat)), cos(radians(b.lat))) * {metre} AS dx
  FROM corridors a, corridors b),
pairs AS MATERIALIZED (SELECT a, b FROM gaps WHERE sqrt(dx * dx + dy * dy) <= reach),
reach AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b),
parts AS (SELECT a AS id, min(b) AS part FROM reach GROUP BY a),
named AS (SELECT c.*, 'RWY_' || lpad(CAST(dense_rank() OVER (ORDER BY part) AS VARCHAR), 3, '0') AS runway_id FROM corridors c JOIN parts USING (id))
""".format(metre=repr(geo.DEGREE_M))


@query("runway_corridors", _OVERLAPS + "SELECT runway_id, id, radius, 2 AS vertices FROM named")
def runway_corridors(s: SparkSession, d: str) -> DataFrame:
    """Corridors with the number of the dissolved part that each belongs to."""
    return _corridors(s, d).select("runway_id", "id", "radius", F.size("line").alias("vertices"))


@query("union_polygons", _OVERLAPS + "SELECT runway_id, count(*) AS corridors, min(x0) AS min_lon, min(lat) AS min_lat, max(x1) AS max_lon, max(lat) AS max_lat FROM named GROUP BY runway_id")
def union_polygons(s: SparkSession, d: str) -> DataFrame:
    """How many corridors each dissolved part has, and its bounds."""
    rows = _corridors(s, d).withColumn("b", geo.bounds(C("line")))
    return rows.groupBy("runway_id").agg(F.count("*").alias("corridors"), F.min("b.min_lon").alias("min_lon"), F.min("b.min_lat").alias("min_lat"), F.max("b.max_lon").alias("max_lon"), F.max("b.max_lat").alias("max_lat"))


@query("airport_cross_join", "SELECT event_id, 'TST' AS airport_code, round(" + fx.METRES.format(a="p", b="o") + ", 1) AS metres FROM points p, (SELECT 32.0 AS lat, -117.0 AS lon) o", "points")
def airport_cross_join(s: SparkSession, d: str) -> DataFrame:
    """Points with the attributes of their airport, a dimension keyed by airport code."""
    dim = s.createDataFrame([(fx.AIRPORT, 32.0, -117.0)], "airport_code string, a_lat double, a_lon double")
    keyed = fx.points(s, d).withColumn("airport_code", F.lit(fx.AIRPORT))
    return keyed.join(F.broadcast(dim), "airport_code").select("event_id", "airport_code", F.round(geo.distance_m(C("lat"), C("lon"), C("a_lat"), C("a_lon")), 1).alias("metres"))


@query("grid_spatial_join", f"SELECT p.event_id, g.gate_id FROM points p JOIN gates g ON {fx.METRES.format(a='p', b='g')} <= 250", "points", "gates")
def grid_spatial_join(s: SparkSession, d: str) -> DataFrame:
    """All pairs of a point and a gate within 250 m."""
    return spatial.places_within(fx.points(s, d), fx.gates(s, d), 250).select("event_id", "gate_id")
