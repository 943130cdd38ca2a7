"""Health of the data: match rates, volumes, freshness, quality metrics, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airside.functions import flight as fl
from airside.functions.time import boundaries, local_ts


def _now(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def _pct(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(F.try_divide(part * 100, whole), digits)


def health_match_rate(local: DataFrame, today: str) -> DataFrame:
    """Points and matched points of a day, and the match rates of it and the day before, in one pass."""
    day = F.lit(today).cast("date")
    on, before = F.col("service_date") == day, F.col("service_date") == F.date_sub(day, 1)
    hit = F.col("schedule_key").isNotNull()
    sums = local.agg(F.count_if(on).alias("points"), F.count_if(on & hit).alias("matched"), F.count_if(before).alias("b"), F.count_if(before & hit).alias("bm"))
    rates = sums.withColumn("match_rate", _pct(F.col("matched"), F.col("points"))).withColumn("match_rate_yesterday", _pct(F.col("bm"), F.col("b")))
    return rates.select("points", "matched", "match_rate", "match_rate_yesterday", F.round(F.col("match_rate") - F.col("match_rate_yesterday"), 1).alias("delta"))


def health_aircraft(local: DataFrame, today: str) -> DataFrame:
    day = F.lit(today).cast("date")
    one = lambda d: F.count_distinct(F.when(F.col("service_date") == d, F.col("icao_hex")))
    return local.agg(one(day).alias("aircraft"), one(F.date_sub(day, 1)).alias("aircraft_yesterday")).withColumn("delta", F.col("aircraft") - F.col("aircraft_yesterday"))


def data_age(points: DataFrame, as_of: str) -> DataFrame:
    age = points.agg(F.max("ts").alias("last_ts")).withColumn("age_minutes", boundaries("minute", F.col("last_ts"), _now(as_of)))
    return age.withColumn("status", fl.freshness_status(F.col("age_minutes")))


def leg_match_trend(legs: DataFrame, results: DataFrame) -> DataFrame:
    leg = ["icao_hex", "service_date", "segment"]
    met = legs.join(results.select(*leg, "schedule_key"), leg, "left")
    return met.groupBy("service_date").agg(F.count("*").alias("legs"), F.count_if(F.col("schedule_key").isNull()).alias("unmatched"), _pct(F.count("schedule_key"), F.count("*")).alias("match_pct"))


def daily_volume(points: DataFrame, tz: str) -> DataFrame:
    return points.groupBy(F.to_date(local_ts(F.col("ts"), tz)).alias("service_date")).agg(F.count("*").alias("points"), F.count_distinct("icao_hex").alias("aircraft"))


def hourly_ingestion(points: DataFrame, tz: str, as_of: str, hours: int = 48) -> DataFrame:
    recent = points.where(F.col("ts") >= F.timestamp_add("HOUR", F.lit(-hours), _now(as_of)))
    hour = F.date_trunc("hour", local_ts(F.col("ts"), tz)).cast("timestamp_ntz")
    return recent.groupBy(hour.alias("hour")).agg(F.count("*").alias("points"), F.count_distinct("icao_hex").alias("aircraft"))


def low_hour_gaps(hourly: DataFrame, last: int = 6, share: float = 0.1) -> DataFrame:
    """Of the last hours those with less than ``share`` of the mean of all hours (a few dozen rows)."""
    mean, place = F.avg("points").over(Window.partitionBy()), F.row_number().over(Window.orderBy(F.col("hour").desc()))
    return hourly.select("hour", "points", F.round(mean, 3).alias("mean_points"), place.alias("n")).where((F.col("n") <= last) & (F.col("points") < F.col("mean_points") * share)).drop("n")


def schedule_volume(schedule: DataFrame, last: str, days: int = 14) -> DataFrame:
    end = F.lit(last).cast("date")
    rows = schedule.where(F.col("flight_date").between(F.date_sub(end, days), end))
    return rows.groupBy("flight_date").agg(F.count("*").alias("flights"), F.count_if(F.col("codeshare_airline").isNull()).alias("operating"))


def freshness_details(points: DataFrame, schedule: DataFrame, found: DataFrame, as_of: str) -> DataFrame:
    """table, last_ts, age, unit of the points, the schedule and the matched legs."""
    now = _now(as_of)
    one = lambda df, c, name, unit: df.agg(F.max(c).alias("last_ts")).select(F.lit(name).alias("table"), "last_ts", boundaries(unit, F.col("last_ts"), now).alias("age"), F.lit(unit).alias("unit"))
    return one(points, "ts", "points", "minute").unionByName(one(schedule, "updated_at", "schedule", "hour")).unionByName(one(found, "anchor_ts", "matches", "minute"))


def refresh_monitor(tables: dict[str, tuple[DataFrame, str]], as_of: str) -> DataFrame:
    """A row for each table: last time, status by age, rows of the last day."""
    now, out = _now(as_of), None
    for name, (df, c) in tables.items():
        recent = F.count_if((F.col(c) > F.timestamp_add("HOUR", F.lit(-24), now)) & (F.col(c) <= now))
        row = df.agg(F.max(c).alias("last_refreshed_at"), recent.alias("rows_24h"))
        row = row.select(F.lit(name).alias("table_name"), "last_refreshed_at", fl.table_freshness(boundaries("hour", F.col("last_refreshed_at"), now)).alias("status"), "rows_24h")
        out = row if out is None else out.unionByName(row)
    return out


def refresh_log(monitor: DataFrame, tz: str) -> DataFrame:
    """The monitor's rows with airport-local time as text, the latest first."""
    shown = F.coalesce(F.date_format(local_ts(F.col("last_refreshed_at"), tz), "yyyy-MM-dd HH:mm"), F.lit(""))
    return monitor.orderBy(F.col("last_refreshed_at").desc_nulls_last(), "table_name").select("table_name", shown.alias("last_refreshed_at"), "status", "rows_24h")


#: Columns whose completeness is reported.
QA_COLUMNS = ["flight", "track", "true_heading", "squawk", "category", "aircraft_desc", "alt_geom", "vertical_rate"]


def qa_metrics(enriched: DataFrame, legs: DataFrame, results: DataFrame, as_of: str) -> DataFrame:
    """The 14 metrics of the day before ``as_of`` by name; one pass over each table, percents as whole numbers."""
    now, leg = _now(as_of), ["icao_hex", "service_date", "segment"]
    day = lambda c: (F.col(c) > F.timestamp_add("HOUR", F.lit(-24), now)) & (F.col(c) <= now)
    part = lambda c: _pct(F.count(c), F.count("*"), 0).cast("long")
    p = enriched.where(day("ts")).agg(
        F.count("*").alias("adsb_points_24h"), F.count_distinct("icao_hex").alias("unique_aircraft_24h"), part("schedule_key").alias("match_rate_pct_24h"),
        *[part(c).alias(f"adsb_{c}_nonnull_pct_24h") for c in QA_COLUMNS],
    )
    met = legs.where(day("end_ts")).join(results.select(*leg, F.lit(1).alias("hit")), leg, "left")
    m = met.agg(F.count("*").alias("flight_legs_24h"), F.count("hit").alias("matched_legs_24h"), part("hit").alias("leg_match_rate_pct_24h"))
    one = p.crossJoin(m)  # one row each
    return one.select(*[F.col(c).cast("long") for c in one.columns]).unpivot([], one.columns, "metric", "value")


def qa_pivot(metrics: DataFrame, names: list[str]) -> DataFrame:
    """A row for each metric_date, a column for each metric."""
    return metrics.groupBy("metric_date").pivot("metric", names).agg(F.max("value"))


def ingest_audit(raw: DataFrame, kept: DataFrame, window: str = "1 hour") -> DataFrame:
    """Rows read, kept and dropped as duplicates for each window of the ingestion."""
    cut = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    read = raw.groupBy(cut.alias("window_start")).agg(F.count("*").alias("rows_raw"))
    had = kept.groupBy(cut.alias("window_start")).agg(F.count("*").alias("rows_inserted"))
    met = read.join(had, "window_start", "left").withColumn("rows_inserted", F.coalesce("rows_inserted", F.lit(0)))
    dropped = F.col("rows_raw") - F.col("rows_inserted")
    return met.withColumn("rows_deduped", dropped).withColumn("status", F.when(F.col("rows_inserted") > 0, "OK").otherwise("EMPTY"))


def smoke_check(runways: DataFrame, points: DataFrame, as_of: str, grace_minutes: int) -> DataFrame:
    """check, passed, detail: there are runways, they have lines, points have positions and are fresh."""
    r = runways.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.size("line"), F.lit(0)) < 2).alias("bad")).select(
        F.inline(F.array(
            F.struct(F.lit("runways").alias("check"), (F.col("n") > 0).alias("passed"), F.col("n").cast("string").alias("detail")),
            F.struct(F.lit("runway_lines").alias("check"), (F.col("bad") == 0).alias("passed"), F.col("bad").cast("string").alias("detail")),
        )))
    age = boundaries("minute", F.max("ts"), _now(as_of))
    p = points.agg(F.count("*").alias("n"), F.count_if(F.col("lat").isNull() | F.col("lon").isNull()).alias("bad"), age.alias("age")).select(
        F.inline(F.array(
            F.struct(F.lit("points_placed").alias("check"), (F.col("bad") == 0).alias("passed"), F.col("bad").cast("string").alias("detail")),
            F.struct(F.lit("points_fresh").alias("check"), F.coalesce(F.col("age") <= grace_minutes, F.lit(False)).alias("passed"), F.coalesce(F.col("age").cast("string"), F.lit("none")).alias("detail")),
        )))
    return r.unionByName(p)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, rows: what an installation has."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


def taxi_times(legs: DataFrame, sessions: DataFrame, most_minutes: int = 60) -> DataFrame:
    """service_date, direction, seconds of each departure (taxi-out) and arrival (taxi-in) with a ground session beside it.

    A departure's taxi-out runs from the start of the aircraft's last session of the day before the leg to the leg's
    start; an arrival's taxi-in from the leg's end to the end of its first session after it. Sessions that
    begin or end more than ``most_minutes`` from the leg don't count.
    """
    l, s = legs.where("direction IN ('departure', 'arrival')").alias("l"), sessions.alias("s")
    met = l.join(s, (F.col("l.icao_hex") == F.col("s.icao_hex")) & (F.col("l.service_date") == F.col("s.service_date")))  # an aircraft's day has some sessions
    out = F.col("l.direction") == "departure"
    before, after = F.timestamp_diff("SECOND", F.col("s.end_ts"), F.col("l.start_ts")), F.timestamp_diff("SECOND", F.col("l.end_ts"), F.col("s.start_ts"))
    gap = F.when(out, before).otherwise(after)
    seconds = F.when(out, F.timestamp_diff("SECOND", F.col("s.start_ts"), F.col("l.start_ts"))).otherwise(F.timestamp_diff("SECOND", F.col("l.end_ts"), F.col("s.end_ts")))
    near = met.select("l.icao_hex", "l.service_date", "l.segment", "l.direction", gap.alias("gap"), seconds.alias("seconds")).where(F.col("gap").between(0, most_minutes * 60))
    return near.groupBy("icao_hex", "service_date", "segment", "direction").agg(F.min_by("seconds", F.struct("gap", "seconds")).alias("seconds")).drop("icao_hex", "segment")


def ops_kpis(legs: DataFrame, sessions: DataFrame, crossings: DataFrame, delays: DataFrame) -> DataFrame:
    """By day: operations, median taxi-out and taxi-in, ground and runway seconds, share of departures within 15 minutes, and
    whether aircraft crossed one runway in both directions (head to head)."""
    taxi = taxi_times(legs, sessions).groupBy("service_date").agg(*[F.round(F.percentile(F.when(F.col("direction") == d, F.col("seconds")), F.lit(0.5)), 1).alias(n) for d, n in (("departure", "median_taxi_out_s"), ("arrival", "median_taxi_in_s"))])
    ways = crossings.groupBy("service_date", "runway_id").agg(F.count_distinct("direction").alias("ways"))
    head = ways.groupBy("service_date").agg((F.max("ways") > 1).alias("head_to_head"))
    ops = legs.where("direction IN ('departure', 'arrival')").groupBy("service_date").agg(F.count_if(F.col("direction") == "departure").alias("departures"), F.count_if(F.col("direction") == "arrival").alias("arrivals"))
    ground = sessions.groupBy("service_date").agg(F.round(F.percentile("dwell_seconds", F.lit(0.5)), 1).alias("median_ground_s"))
    runway = crossings.groupBy("service_date").agg(F.round(F.percentile("seconds", F.lit(0.5)), 1).alias("median_runway_s"))
    timely = delays.groupBy(F.col("flight_date").alias("service_date")).agg(_pct(F.sum(F.col("flights") - F.col("delayed")), F.sum("flights")).alias("on_time_pct"))
    out = ops
    for more in (taxi, ground, runway, head, timely):
        out = out.join(more, "service_date", "full")
    return out
