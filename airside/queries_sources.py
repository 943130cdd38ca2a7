"""Queries of sources and streams: payload files derived from the given tables, written, read and worked through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airside.functions import flight as fl
from airside.functions.time import service_date
from airside.operators import gold
from airside.plans import fixtures as fx
from airside.plans.fixtures import TZ
from airside.registry import query
from airside.sources import files
from airside.streaming import jobs

C = F.col


def _utc(c: str) -> F.Column:
    """A time without zone, meant as UTC, as an instant."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), C(c)).cast("timestamp")


def _plain(c: str) -> F.Column:
    """An instant as a time without zone in UTC."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), C(c).cast("timestamp_ntz"))


def _landed(s: SparkSession, rows: DataFrame, tag: str) -> str:
    path = files.scratch(s, tag)
    rows.write.parquet(path)
    return path


# --- files ---------------------------------------------------------------------------------------
_NATIONS = "SELECT n_nationkey AS k, n_name AS name FROM nation"


def _airline_csv(s: SparkSession, d: str) -> DataFrame:
    """Airline rows of the nations, with every kind of null token."""
    rows = s.read.parquet(f"{d}/nation.parquet").selectExpr(
        "CASE WHEN n_nationkey % 5 = 0 THEN 'x' ELSE CAST(n_nationkey AS STRING) END AS id", "n_name AS name", "CASE n_nationkey % 4 WHEN 0 THEN '\\\\N' WHEN 1 THEN '-' ELSE substr(n_name, 1, 2) END AS iata",
        "CASE WHEN n_nationkey % 6 = 0 THEN 'N/A' ELSE substr(n_name, 1, 3) END AS icao", "concat('call \"', n_name, '\", x') AS callsign", "'' AS country", "'Y' AS active",
    )
    path = files.scratch(s, "airlines")
    rows.write.option("header", True).option("escape", '"').csv(path)
    return files.read_airline_csv(s, path)


@query("read_airline_csv", "SELECT CASE WHEN n_nationkey % 5 <> 0 THEN CAST(n_nationkey AS INT) END AS airline_id, n_name AS airline_name, CASE WHEN n_nationkey % 4 > 1 THEN substr(n_name, 1, 2) END AS airline_iata, CASE WHEN n_nationkey % 6 <> 0 THEN substr(n_name, 1, 3) END AS airline_icao, 'call \"' || n_name || '\", x' AS airline_callsign, CAST(NULL AS VARCHAR) AS country FROM nation")
def read_airline_csv(s: SparkSession, d: str) -> DataFrame:
    return _airline_csv(s, d).drop("is_active")


@query("airline_code_map", "SELECT airline_iata, airline_icao, max(n_name) AS airline_name FROM (SELECT upper(substr(n_name, 1, 2)) AS airline_iata, upper(substr(n_name, 1, 3)) AS airline_icao, n_name FROM nation WHERE n_nationkey % 4 > 1 AND n_nationkey % 6 <> 0) GROUP BY ALL")
def airline_code_map(s: SparkSession, d: str) -> DataFrame:
    return files.airline_code_map(_airline_csv(s, d))


_TRACE = """concat('{"icao":"', icao_hex, '","r":', coalesce(concat('"', registration, '"'), 'null'), ',"timestamp":1704067200,"trace":[', array_join(transform(sort_array(collect_list(struct(sec, event_id,
  concat('[', sec, ',', format_string('%.4f', lat), ',', format_string('%.4f', lon), ',', CASE WHEN altitude_baro IS NULL THEN '"ground"' ELSE CAST(altitude_baro AS STRING) END, ',', velocity, ',null,0,', CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 100 AS STRING) ELSE 'null' END, ',',
    CASE WHEN event_id % 3 = 0 THEN 'null' ELSE concat('{"flight":', coalesce(concat('"', flight, ' "'), 'null'), ',"baro_rate":', event_id % 7, ',"squawk":"', event_id % 5, '"}') END, ']') AS p))), x -> x.p), ','), ']}') AS value"""


def _traces(s: SparkSession, d: str) -> DataFrame:
    """day, trace: aircraft-days of the points, written as gzip NDJSON with a bad line in each file."""
    rows = fx.points(s, d).groupBy("icao_hex", "registration").agg(F.expr(_TRACE.replace(" AS value", "")).alias("value")).select("value", F.lit("2024-01-01").alias("day"))
    bad = s.range(1).select(F.lit("not json").alias("value"), F.lit("2024-01-01").alias("day"))
    path = files.scratch(s, "traces")
    rows.unionByName(bad).write.partitionBy("day").option("compression", "gzip").text(path)
    return files.load_trace_ndjson(s, path)


@query("load_trace_ndjson", "SELECT DISTINCT icao_hex, DATE '2024-01-01' AS day FROM points", "points")
def load_trace_ndjson(s: SparkSession, d: str) -> DataFrame:
    return _traces(s, d).select(F.expr("try_variant_get(trace, '$.icao', 'string')").alias("icao_hex"), "day")


_FLAT = """SELECT icao_hex, CAST(row_number() OVER (PARTITION BY icao_hex ORDER BY sec, event_id) - 1 AS INT) AS n, ts, lat, lon, coalesce(altitude_baro, 0) AS altitude_baro, velocity,
  CASE WHEN event_id % 2 = 0 THEN event_id % 100 WHEN event_id % 3 <> 0 THEN event_id % 7 END AS vertical_rate, CASE WHEN event_id % 3 <> 0 THEN flight END AS f, CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 5 AS VARCHAR) END AS q FROM points"""
_NEAR_50 = fx.NEAR_AIRPORT.replace("5000", "50000")


@query("flatten_trace", f"SELECT icao_hex, n, ts, lat, lon, altitude_baro, velocity, CAST(vertical_rate AS INT) AS vertical_rate FROM ({_FLAT}) WHERE {_NEAR_50}", "points")
def flatten_trace(s: SparkSession, d: str) -> DataFrame:
    return files.flatten_trace(_traces(s, d), fx.ring()).select("icao_hex", "n", "ts", "lat", "lon", "altitude_baro", "velocity", "vertical_rate")


@query("trace_attr_fill", f"SELECT icao_hex, n, coalesce(f, max(f) OVER (PARTITION BY icao_hex)) AS flight, coalesce(q, max(q) OVER (PARTITION BY icao_hex)) AS squawk FROM ({_FLAT}) WHERE {_NEAR_50}", "points")
def trace_attr_fill(s: SparkSession, d: str) -> DataFrame:
    return files.flatten_trace(_traces(s, d), fx.ring()).select("icao_hex", "n", "flight", "squawk")


def _snapshots(s: SparkSession, d: str, unit: str = "minute") -> DataFrame:
    """value, fetched_at: a payload for each minute (or other unit) of the points; some lack a position."""
    one = """named_struct('hex', icao_hex, 'flight', flight || ' ', 'r', registration, 't', type, 'desc', type || ' x', 'lat', CASE WHEN event_id % 13 <> 0 THEN lat END, 'lon', lon,
      'alt_baro', CASE WHEN altitude_baro IS NULL THEN 'ground' WHEN event_id % 17 = 0 THEN 'odd' ELSE CAST(altitude_baro AS STRING) END,
      'alt_geom', CASE WHEN event_id % 3 <> 0 THEN event_id % 900 END, 'gs', velocity, 'track', CAST(event_id % 360 AS DOUBLE), 'true_heading', CASE WHEN event_id % 5 <> 0 THEN CAST(event_id * 7 % 360 AS DOUBLE) END,
      'baro_rate', event_id % 41 - 20, 'squawk', lpad(CAST(event_id % 4096 AS STRING), 4, '0'), 'category', category)"""
    by = fx.points(s, d).groupBy(F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("fetched_at"))
    return by.agg(F.to_json(F.struct(F.expr(f"collect_list({one})").alias("ac"))).alias("value"))


_SNAPSHOT_ROWS = """
SELECT icao_hex, flight, registration, type, type || ' x' AS aircraft_desc, lat, lon, CASE WHEN altitude_baro IS NULL THEN 0 WHEN event_id % 17 <> 0 THEN altitude_baro END AS altitude_baro,
  CAST(CASE WHEN event_id % 3 <> 0 THEN event_id % 900 END AS INT) AS altitude_geom, velocity, CAST(event_id % 360 AS DOUBLE) AS track,
  CASE WHEN event_id % 5 <> 0 THEN CAST(event_id * 7 % 360 AS DOUBLE) END AS true_heading, CAST(event_id % 41 - 20 AS INT) AS vertical_rate,
  lpad(CAST(event_id % 4096 AS VARCHAR), 4, '0') AS squawk, category, date_trunc('minute', ts) AS ts
FROM points WHERE event_id % 13 <> 0
"""


@query("live_snapshot_parse", _SNAPSHOT_ROWS, "points")
def live_snapshot_parse(s: SparkSession, d: str) -> DataFrame:
    return files.live_snapshot_parse(_snapshots(s, d))


def _payload_files(s: SparkSession, d: str) -> str:
    """Schedule payloads in three files a day, of which one of the second day is cut short; in front of them lies a day without any."""
    flights = fx.schedule(s, d).select(F.col("flight_date").alias("day"), (C("schedule_key") % 3).alias("file"), F.struct("schedule_key", "flight_iata", "dep_airport").alias("f"))
    whole = flights.groupBy("day", "file").agg(F.to_json(F.struct(F.sort_array(F.collect_list("f")).alias("data"))).alias("value"))
    cut = F.when((C("day") == F.lit("2024-01-01").cast("date")) & (C("file") == 1), F.substring("value", 1, 20)).otherwise(C("value"))
    path = files.scratch(s, "payloads")
    whole.select("day", "file", cut.alias("value")).repartition("day", "file").write.partitionBy("day", "file").text(path)
    return path


_WINDOW = """
SELECT CAST(day AS DATE) AS day, CASE WHEN n IS NULL THEN 'missing' WHEN bad = 0 THEN 'loaded' WHEN bad < n THEN 'partly' ELSE 'failed' END AS status, coalesce(n, 0) AS files, coalesce(bad, 0) AS failed
FROM (SELECT unnest(generate_series(timestamp '2023-12-31', timestamp '2024-01-02', INTERVAL 1 DAY)) AS day)
LEFT JOIN (SELECT flight_date, count(DISTINCT schedule_key % 3) AS n, count(DISTINCT schedule_key % 3) FILTER (schedule_key % 3 = 1) AS bad FROM schedule GROUP BY 1) ON flight_date = day
"""


@query("schedule_window_report", _WINDOW, "schedule")
def schedule_window_report(s: SparkSession, d: str) -> DataFrame:
    """A file that was cut short fails alone: its day is loaded in part, the others wholly or not at all."""
    return files.schedule_window_backfill(files.read_payloads(s, _payload_files(s, d)), "2024-01-01", 1, 1)[1]


@query("schedule_window_backfill", "SELECT schedule_key FROM schedule WHERE schedule_key % 3 = 2 OR schedule_key % 3 = 1 AND flight_date <> DATE '2024-01-01'", "schedule")
def schedule_window_backfill(s: SparkSession, d: str) -> DataFrame:
    """Flights of the files that parse and haven't been loaded before, which each day's first file has."""
    path = _payload_files(s, d)
    loaded = files.list_files(s, path).where("path LIKE '%/file=0/%'")
    good, _ = files.schedule_window_backfill(files.read_payloads(s, path, loaded), "2024-01-01", 1, 1)
    keys = F.from_json("value", "struct<data: array<struct<schedule_key: bigint>>>")["data"]["schedule_key"]
    return good.select(F.explode(keys).alias("schedule_key"))


@query("tsa_parallel_arrays_flatten", "SELECT 'CP' || CAST(l_suppkey % 7 AS VARCHAR) AS checkpoint, CAST(l_orderkey AS VARCHAR) AS date, CASE WHEN l_linenumber <= 2 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) ELSE '' END AS passengers FROM lineitem")
def tsa_parallel_arrays_flatten(s: SparkSession, d: str) -> DataFrame:
    """An order's lines as parallel arrays; the passengers of its first two lines only."""
    lines = s.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_quantity"))).alias("x"))
    arrays = lines.select(
        F.transform("x", lambda r: C("l_orderkey").cast("string")).alias("date"), F.transform("x", lambda r: F.concat(F.lit("CP"), (r["l_suppkey"] % 7).cast("string"))).alias("checkpoint"),
        F.transform(F.filter("x", lambda r: r["l_linenumber"] <= 2), lambda r: r["l_quantity"].cast("int").cast("string")).alias("passengers"),
    )
    return files.tsa_parallel_arrays_flatten(arrays, ["checkpoint", "date", "passengers"])


_LATEST = """
SELECT 'report_' || strftime(d, '%m-%d-%Y') AS report, CAST(d AS DATE) AS end_date FROM (SELECT max(o_orderdate) AS d FROM orders)
"""


@query("latest_file_pick", _LATEST)
def latest_file_pick(s: SparkSession, d: str) -> DataFrame:
    """Report files of the last order day of each year are listed; once the newest is loaded, there is none to pick."""
    orders = s.read.parquet(f"{d}/orders.parquet").groupBy(F.year("o_orderdate").alias("y")).agg(F.max("o_orderdate").alias("day"), F.count("*").cast("string").alias("value"))
    path = files.scratch(s, "reports")
    orders.select("value", F.concat(F.lit("report_"), F.date_format("day", "MM-dd-yyyy")).alias("report")).write.partitionBy("report").text(path)
    found = files.list_files(s, path)
    newest = files.latest_file_pick(found, found.limit(0))
    both = newest.unionByName(files.latest_file_pick(found, newest))
    return both.select(F.regexp_extract("path", "report=([^/]*)", 1).alias("report"), "end_date")


_STATES = """
SELECT CAST(day AS DATE) AS day, CASE WHEN r.n > 0 THEN 'processed' WHEN a.n > 0 THEN 'loaded' WHEN day = timestamp '2024-01-02' THEN 'extracted' WHEN day = timestamp '2024-01-03' THEN 'downloaded' ELSE 'pending' END AS status,
  CASE WHEN a.n > 0 OR day BETWEEN timestamp '2024-01-02' AND timestamp '2024-01-03' THEN 1 ELSE 0 END AS files, coalesce(a.n, 0) AS aircraft, coalesce(r.n, 0) AS rows
FROM (SELECT unnest(generate_series(timestamp '2023-12-30', timestamp '2024-01-03', INTERVAL 1 DAY)) AS day)
LEFT JOIN (SELECT service_date AS d, count(DISTINCT icao_hex) AS n FROM labelled GROUP BY 1) a ON a.d = day
LEFT JOIN (SELECT service_date AS d, count(*) AS n FROM labelled WHERE service_date = DATE '2024-01-01' GROUP BY 1) r ON r.d = day
"""


@query("backfill_day_status", _STATES, "labelled")
def backfill_day_status(s: SparkSession, d: str) -> DataFrame:
    """Days at every state, told from files and tables: two have traces in the raw table, one of them points, one has
    trace lines only, one a file only, and one nothing."""
    p = fx.points(s, d).withColumn("day", service_date(C("ts"), TZ))
    raw = p.select("day", "icao_hex").distinct()
    lines = raw.groupBy("day").agg(F.min("icao_hex").alias("value")).unionByName(s.sql("SELECT DATE'2024-01-02' AS day, '{}' AS value"))
    downloaded = lines.unionByName(s.sql("SELECT DATE'2024-01-03' AS day, 'x' AS value"))
    paths = {tag: files.scratch(s, tag) for tag in ("downloaded", "extracted", "raw", "points")}
    for tag, rows in (("downloaded", downloaded), ("extracted", lines), ("raw", raw), ("points", p.where("day = DATE'2024-01-01'").select("event_id", "day"))):
        whole = rows.repartition("day").write.partitionBy("day")
        whole.text(paths[tag]) if "value" in rows.columns else whole.parquet(paths[tag])
    days = s.range(1).select(F.explode(F.sequence(F.lit("2023-12-30").cast("date"), F.lit("2024-01-03").cast("date"))).alias("day"))
    extracted = s.read.schema("value string, day date").text(paths["extracted"])
    return files.backfill_day_status(days, files.list_files(s, paths["downloaded"]), extracted, s.read.parquet(paths["raw"]), s.read.parquet(paths["points"]))


# --- streams -----------------------------------------------------------------------------------------
_END = "2030-01-01 00:00:00"


def _stream(s: SparkSession, d: str, *columns: str, rows: DataFrame | None = None) -> DataFrame:
    """The points as a stream of files, in two landings one after the other, then a row far ahead that
    moves the watermark past all others."""
    from pyspark.sql.types import StructType

    p = (fx.points(s, d) if rows is None else rows).withColumn("ts", _utc("ts")).select("event_id", "icao_hex", "ts", *columns)
    noon = _at("2024-01-01 07:00:00")
    path = files.scratch(s, "stream")
    end = p.limit(1).withColumn("icao_hex", F.lit("~")).withColumn("event_id", F.lit(-1).cast("long")).withColumn("ts", _at(_END))
    for part in (p.where(C("ts") < noon), p.where(C("ts") >= noon), end):
        part.coalesce(2).write.mode("append").parquet(path)
    schema: StructType = p.schema
    return s.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(path)


def _at(text: str) -> F.Column:
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.lit(text).cast("timestamp_ntz")).cast("timestamp")


def _run(s: SparkSession, stream: DataFrame) -> DataFrame:
    """All that a stream appends, by way of files."""
    path = files.scratch(s, "streamed")
    job = stream.writeStream.format("parquet").option("checkpointLocation", files.scratch(s, "checkpoint")).trigger(availableNow=True).start(path)
    job.awaitTermination()
    return s.read.schema(stream.schema).parquet(path)


@query("stream_positions", f"SELECT * EXCLUDE (ts) FROM ({_SNAPSHOT_ROWS})", "points")
def stream_positions(s: SparkSession, d: str) -> DataFrame:
    """Payload files, a document for each hour, some at a time; the time of observation is the file's and left out here."""
    path = files.scratch(s, "snapshots")
    _snapshots(s, d, "hour").repartition(4).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return _run(s, jobs.stream_positions(s, path, 5)).drop("ts")


@query("stream_dedup", "SELECT DISTINCT icao_hex, ts FROM points", "points")
def stream_dedup(s: SparkSession, d: str) -> DataFrame:
    return _run(s, jobs.stream_dedup(_stream(s, d)).select("icao_hex", "ts")).where("icao_hex <> '~'").select("icao_hex", _plain("ts").alias("ts"))


@query("stream_hourly", "SELECT date_trunc('hour', ts) AS hour, count(*) AS records, true AS within FROM points GROUP BY 1", "points")
def stream_hourly(s: SparkSession, d: str) -> DataFrame:
    """The stored sketches of the stream give the aircraft of every hour within 3 %."""
    found = _run(s, jobs.stream_hourly(_stream(s, d))).select(_plain("hour").alias("hour"), "records", F.hll_sketch_estimate("aircraft_sketch").alias("aircraft"))
    exact = gold.traffic_hourly(fx.points(s, d)).select("hour", F.col("aircraft").alias("exact"))
    return found.join(exact, "hour").select("hour", "records", (F.abs(C("aircraft") - C("exact")) <= C("exact") * 0.03).alias("within"))


@query("stream_sessions", "SELECT icao_hex, service_date, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS points FROM sessions GROUP BY icao_hex, service_date, session_seq", "sessions")
def stream_sessions(s: SparkSession, d: str) -> DataFrame:
    ground = fx.points(s, d).where(fl.is_ground_gate(C("velocity"), C("altitude_baro")))
    found = _run(s, jobs.stream_sessions(_stream(s, d, rows=ground), TZ)).where("icao_hex <> '~'")
    return found.select("icao_hex", "service_date", _plain("start_ts").alias("start_ts"), _plain("end_ts").alias("end_ts"), "points")
