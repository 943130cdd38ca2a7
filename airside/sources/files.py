"""Readers of the payload files: airline CSV, aircraft traces, live snapshots, schedules."""

from __future__ import annotations

import tempfile
import uuid
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airside.operators.cover import near_ring

#: Texts that mean null in the airline file.
NULL_TOKENS = ["\\N", "N/A", "-", ""]


def read_airline_csv(spark: SparkSession, path: str) -> DataFrame:
    """Airline reference rows; the id is read leniently, null tokens become null."""
    names = ["airline_id", "airline_name", "airline_iata", "airline_icao", "airline_callsign", "country", "is_active"]
    raw = spark.read.schema(", ".join(f"{n} string" for n in names)).option("header", True).option("escape", '"').csv(path)
    clean = raw.select(*[F.when(~F.trim(n).isin(NULL_TOKENS), F.trim(n)).alias(n) for n in names])
    return clean.withColumn("airline_id", F.expr("try_cast(airline_id AS int)"))


def airline_code_map(airlines: DataFrame) -> DataFrame:
    """(iata, icao) pairs of two and three letters with the greatest name."""
    pairs = airlines.select(F.upper(F.trim("airline_iata")).alias("airline_iata"), F.upper(F.trim("airline_icao")).alias("airline_icao"), "airline_name")
    return pairs.where((F.length("airline_iata") == 2) & (F.length("airline_icao") == 3)).groupBy("airline_iata", "airline_icao").agg(F.max("airline_name").alias("airline_name"))


def load_trace_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """day, trace: one JSON line for each aircraft and day (gzip or plain), the day from the path
    (day=YYYY-MM-DD or any date in a file's name); lines that don't parse are left out."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("trace"))
    day = F.regexp_extract("file", r"(\d{4}[-.]\d{2}[-.]\d{2})[^/]*(?:/[^/]*)?$", 1)
    return raw.where("trace IS NOT NULL").select(F.try_to_date(F.replace(day, F.lit("."), F.lit("-")), "yyyy-MM-dd").alias("day"), "trace")


_POINTS_OF = """
SELECT *, p.pos AS n, p.value AS v FROM (
  SELECT try_variant_get(trace, '$.icao', 'string') AS icao_hex, try_variant_get(trace, '$.r', 'string') AS registration, try_variant_get(trace, '$.t', 'string') AS type,
    try_variant_get(trace, '$.flight', 'string') AS top_flight, try_variant_get(trace, '$.squawk', 'string') AS top_squawk, try_variant_get(trace, '$.category', 'string') AS top_category,
    try_variant_get(trace, '$.timestamp', 'double') AS base, trace FROM {traces}), LATERAL variant_explode(variant_get(trace, '$.trace')) AS p
"""


def flatten_trace(traces: DataFrame, ring: Column | None = None, near_m: float = 50_000) -> DataFrame:
    """Points of the traces: positional fields, ground altitude 0, time to the millisecond.

    The vertical rate is the point's own, else the barometric, else the geometric one. With a
    ring (of the airport) only points within ``near_m`` of it. Flight, squawk and category are
    filled by ``trace_attr_fill``. Points without a position are left out if there is a ring.
    """
    points = traces.sparkSession.sql(_POINTS_OF, traces=traces)
    get = lambda i, kind: F.expr(f"try_variant_get(v, '$[{i}]', '{kind}')")
    more = lambda name, kind: F.expr(f"try_variant_get(v, '$[8].{name}', '{kind}')")
    millis = (F.col("base") * 1000).cast("long") + F.round(get(0, "double") * 1000).cast("long")
    zone = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_millis(millis).cast("timestamp_ntz"))
    rows = points.select(
        "icao_hex", "registration", "type", "n", zone.alias("ts"), get(1, "double").alias("lat"), get(2, "double").alias("lon"), F.coalesce(get(3, "int"), F.lit(0)).alias("altitude_baro"),
        get(4, "double").alias("velocity"), get(5, "double").alias("track"), F.coalesce(get(7, "int"), more("baro_rate", "int"), more("geom_rate", "int")).alias("vertical_rate"),
        more("true_heading", "double").alias("true_heading"), more("alt_geom", "int").alias("altitude_geom"),
        F.coalesce("top_flight", more("flight", "string")).alias("flight"), F.coalesce("top_squawk", more("squawk", "string")).alias("squawk"), F.coalesce("top_category", more("category", "string")).alias("category"),
    )
    return trace_attr_fill(rows if ring is None else near_ring(rows, ring, near_m, "near").where("near").drop("near"))


def trace_attr_fill(points: DataFrame) -> DataFrame:
    """Points whose flight, squawk and category, where missing, are the greatest of their aircraft's."""
    w = Window.partitionBy("icao_hex")
    for c in ("flight", "squawk", "category"):
        points = points.withColumn(c, F.nullif(F.trim(c), F.lit(""))).withColumn(c, F.coalesce(c, F.max(c).over(w)))
    return points


_SNAPSHOT = """struct<ac: array<struct<hex: string, flight: string, r: string, t: string, desc: string, lat: double, lon: double, alt_baro: string, alt_geom: double,
  gs: double, track: double, true_heading: double, baro_rate: double, squawk: string, category: string>>>"""


def live_snapshot_parse(payloads: DataFrame) -> DataFrame:
    """Rows of the ``ac`` array of API payloads (value, fetched_at); no position, no row; ground altitude 0.

    Altitudes and the vertical rate are whole numbers; an altitude that is no number is null.
    """
    rows = payloads.select("fetched_at", F.explode(F.from_json("value", _SNAPSHOT)["ac"]).alias("a")).where("a.lat IS NOT NULL AND a.lon IS NOT NULL")
    altitude = F.when(F.col("a.alt_baro") == "ground", 0).otherwise(F.expr("try_cast(a.alt_baro AS int)"))
    whole = lambda c: F.round(f"a.{c}").cast("int")
    return rows.select(
        F.col("a.hex").alias("icao_hex"), F.trim("a.flight").alias("flight"), F.col("a.r").alias("registration"), F.col("a.t").alias("type"), F.col("a.desc").alias("aircraft_desc"),
        "a.lat", "a.lon", altitude.alias("altitude_baro"), whole("alt_geom").alias("altitude_geom"), F.col("a.gs").alias("velocity"), "a.track", "a.true_heading",
        whole("baro_rate").alias("vertical_rate"), "a.squawk", "a.category", F.col("fetched_at").alias("ts"),
    )


def tsa_parallel_arrays_flatten(reports: DataFrame, fields: list[str]) -> DataFrame:
    """Rows from parallel arrays; as many as ``date`` has, missing entries are empty text."""
    at = F.sequence(F.lit(0), F.size("date") - 1)
    rows = F.transform(at, lambda i: F.struct(*[F.coalesce(F.get(F.col(f), i), F.lit("")).alias(f) for f in fields]))
    return reports.where(F.size("date") > 0).select(F.inline(rows))


_DAY_IN_PATH = r"day=(\d{4}-\d{2}-\d{2})/"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, day (of a folder day=YYYY-MM-DD, else null), length and modified of all files below ``root``; none is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    day = F.try_to_date(F.nullif(F.regexp_extract("path", _DAY_IN_PATH, 1), F.lit("")), "yyyy-MM-dd")
    return found.select("path", day.alias("day"), "length", F.col("modificationTime").alias("modified"))


def read_payloads(spark: SparkSession, root: str, loaded: DataFrame | None = None) -> DataFrame:
    """path, day, value, failed of payload files, a JSON document each; those in ``loaded`` (path) are passed over.

    A file that doesn't parse is a row with ``failed`` set and its text kept, so that nothing gets lost unseen.
    """
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(root).select(F.col("_metadata.file_path").alias("path"), "value")
    if loaded is not None:
        raw = raw.join(loaded.select("path"), "path", "left_anti")
    day = F.try_to_date(F.nullif(F.regexp_extract("path", _DAY_IN_PATH, 1), F.lit("")), "yyyy-MM-dd")
    return raw.select("path", day.alias("day"), "value", F.try_parse_json("value").isNull().alias("failed"))


def schedule_window_backfill(payloads: DataFrame, today: str, back: int, ahead: int) -> tuple[DataFrame, DataFrame]:
    """Payloads of the window's days that can be loaded (flight_date, value, path), and a report with every day of it.

    ``payloads`` as ``read_payloads`` gives them. The report has day, status, files, failed: loaded, partly (some
    files failed), failed (all did) or missing (no file). One bad day doesn't hold up the others.
    """
    days = [date.fromisoformat(today) + timedelta(days=n) for n in range(-back, ahead + 1)]
    window = payloads.where(F.col("day").isin(days))
    counted = window.groupBy("day").agg(F.count("*").alias("files"), F.count_if("failed").alias("failed"))
    every = payloads.sparkSession.createDataFrame([(d,) for d in days], "day date").join(counted, "day", "left").na.fill(0, ["files", "failed"])
    status = F.when(F.col("files") == 0, "missing").when(F.col("failed") == 0, "loaded").when(F.col("failed") < F.col("files"), "partly").otherwise("failed")
    return window.where("NOT failed").select(F.col("day").alias("flight_date"), "value", "path"), every.select("day", status.alias("status"), "files", "failed")


def latest_file_pick(files: DataFrame, loaded: DataFrame) -> DataFrame:
    """Of files (path) the one whose name has the latest end date (MM-DD-YYYY), unless it is in ``loaded`` (path)."""
    ends = F.regexp_extract_all("path", F.lit(r"(\d{2}-\d{2}-\d{4})"), 1)
    dated = files.withColumn("end_date", F.try_to_date(F.get(ends, F.size(ends) - 1), "MM-dd-yyyy")).where("end_date IS NOT NULL")
    return dated.orderBy(F.col("end_date").desc(), F.col("path").desc()).limit(1).join(loaded.select("path"), "path", "left_anti")


def backfill_day_status(expected: DataFrame, downloaded: DataFrame, extracted: DataFrame, loaded: DataFrame, processed: DataFrame) -> DataFrame:
    """day, status, files, aircraft, rows of every expected day, from what is there of it.

    The furthest state counts: processed (``processed`` has points of the day), loaded (the raw table
    has aircraft), extracted (there are trace lines), downloaded (there are files), else pending. All have a column day.
    """
    found = expected.select("day")
    for name, rows in (("files", downloaded), ("lines", extracted), ("aircraft", loaded), ("rows", processed)):
        found = found.join(rows.groupBy("day").agg(F.count("*").alias(name)), "day", "left")
    found = found.na.fill(0, ["files", "lines", "aircraft", "rows"])
    status = F.when(F.col("rows") > 0, "processed").when(F.col("aircraft") > 0, "loaded").when(F.col("lines") > 0, "extracted").when(F.col("files") > 0, "downloaded").otherwise("pending")
    return found.select("day", status.alias("status"), "files", "aircraft", "rows")


def replace_days(rows: DataFrame, path: str) -> None:
    """Write rows (with a column day) so that each day in them replaces what was there; other days stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def scratch(spark: SparkSession, tag: str) -> str:
    """A path that nothing uses yet, in the folder that all machines share (``spark.checkpoint.dir``);
    a session without that setting (a local test) gets a temporary one."""
    given = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="airside-")
    return f"{given.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, tag: str) -> DataFrame:
    """Write an intermediate table and read it back: one copy for all that need it, and short plans."""
    path = scratch(rows.sparkSession, tag)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
