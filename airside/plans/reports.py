"""Dashboard reports: small aggregations over the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airside.functions import flight as fl
from airside.functions import geo
from airside.functions.time import boundaries, day_of_week, local_ts
from airside.operators.keyed import top_per_key
from airside.operators.quantile import exact_quantile


def date_bounds(points: DataFrame, tz: str) -> DataFrame:
    day = F.to_date(local_ts(F.col("ts"), tz))
    return points.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def live_positions(points: DataFrame, as_of: str, minutes: int, limit: int = 500) -> DataFrame:
    """The latest point of every flight seen in the last minutes."""
    now = F.lit(as_of).cast("timestamp_ntz")
    recent = points.where((F.col("ts") <= now) & (boundaries("second", F.col("ts"), now) <= 60 * max(1, min(60, minutes)))).withColumn("flight_id", fl.flight_id(F.col("flight"), F.col("icao_hex")))
    latest = top_per_key(recent, ["flight_id"], [F.col("ts").desc(), F.col("event_id").desc()])
    return latest.orderBy(F.col("ts").desc(), "flight_id").limit(limit).select("flight_id", "ts", "lat", "lon", "velocity", "altitude_baro")


def trajectories(points: DataFrame, keep: int, tz: str) -> DataFrame:
    """About ``keep`` points of each flight of a day, always with the first and the last, in order."""
    rows = points.withColumn("flight_id", fl.flight_id(F.col("flight"), F.col("icao_hex"))).withColumn("service_date", F.to_date(local_ts(F.col("ts"), tz)))
    w = Window.partitionBy("service_date", "flight_id").orderBy("ts", "event_id")
    n = F.count("*").over(Window.partitionBy("service_date", "flight_id"))
    numbered = rows.withColumn("rn", F.row_number().over(w)).withColumn("n", n)
    step = F.greatest(F.lit(1), F.floor(F.col("n") / keep)).cast("int")
    kept = numbered.where((F.col("rn") == 1) | (F.col("rn") == F.col("n")) | (F.pmod(F.col("rn") - 1, step) == 0))
    path = F.transform(F.sort_array(F.collect_list(F.struct("rn", "lon", "lat"))), lambda p: F.concat_ws(" ", F.format_string("%.4f", p["lon"]), F.format_string("%.4f", p["lat"])))
    return kept.groupBy("service_date", "flight_id").agg(F.count("*").alias("points"), F.array_join(path, ",").alias("path"))


def track_segments(points: DataFrame, tz: str) -> DataFrame:
    """Consecutive pairs of the points of a flight's day with the altitude scaled to 0..1."""
    rows = points.where("altitude_baro IS NOT NULL").withColumn("flight_id", fl.flight_id(F.col("flight"), F.col("icao_hex"))).withColumn("service_date", F.to_date(local_ts(F.col("ts"), tz)))
    all_ = Window.partitionBy("service_date", "flight_id")
    w = all_.orderBy("ts", "event_id")
    low, high = F.min("altitude_baro").over(all_), F.max("altitude_baro").over(all_)
    scaled = F.when(high > low, (F.col("altitude_baro") - low) / (high - low)).otherwise(0.0)
    return rows.select("flight_id", "event_id", F.lead("event_id").over(w).alias("next_id"), F.round(scaled, 6).alias("altitude_scaled")).where("next_id IS NOT NULL")


def hex_density(points: DataFrame, degrees: float, days: int, top: int = 4000, box: tuple[float, float, float, float] | None = None, share: float = 1.0, seed: int = 1) -> DataFrame:
    """Flights and points a day by hexagon, with up to 15 callsigns, densest first.

    ``box`` (min lat, min lon, max lat, max lon) and ``share`` (a sample of the points) narrow it down.
    """
    rows = points if box is None else points.where(F.col("lat").between(box[0], box[2]) & F.col("lon").between(box[1], box[3]))
    rows = rows if share >= 1 else rows.sample(share, seed)
    # Places, then cells, come out of generators, so that neither is worked out again at each mention.
    placed = rows.select("icao_hex", "flight", F.inline(F.array(F.struct(F.col("lat").alias("lat"), F.col("lon").alias("lon")))))
    q, r = geo.hex_cell(F.col("lat"), F.col("lon"), degrees)
    cells = placed.select("icao_hex", "flight", F.inline(F.array(F.struct(q.alias("q"), r.alias("r")))))
    # Both results start from this aggregate, whose shuffle Spark uses again.
    flights = cells.groupBy("q", "r", "icao_hex", "flight").agg(F.count("*").alias("n"))
    counted = flights.groupBy("q", "r").agg(F.sum("n").alias("n"), F.count_distinct("icao_hex").alias("aircraft"))
    named = top_per_key(flights.where("flight IS NOT NULL").select("q", "r", "flight").distinct(), ["q", "r"], [F.col("flight").asc()], 15)
    names = named.groupBy("q", "r").agg(F.array_join(F.sort_array(F.collect_list("flight")), ",").alias("callsigns"))
    dense = counted.orderBy(F.col("n").desc(), "q", "r").limit(top)
    return dense.join(names, ["q", "r"], "left").select("q", "r", "aircraft", F.round(F.col("n") / days, 4).alias("points_per_day"), "callsigns")


def traffic_of_days(sketches: DataFrame, tz: str) -> DataFrame:
    """Records and aircraft of each local day from hourly sketches (see ``gold.traffic_sketches``).

    An aircraft of several hours counts once: sketches are merged, not counts added. Zones whose offset
    isn't whole hours have hours that belong to two days; they count for the day they begin in.
    """
    merged = sketches.groupBy(F.to_date(local_ts(F.col("hour"), tz)).alias("service_date")).agg(F.sum("records").alias("records"), F.hll_union_agg("aircraft_sketch").alias("s"))
    return merged.select("service_date", "records", F.hll_sketch_estimate("s").alias("aircraft"))


def traffic_of_range(sketches: DataFrame) -> DataFrame:
    """First and last hour, records, and aircraft of all hours together."""
    merged = sketches.agg(F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"), F.sum("records").alias("records"), F.hll_union_agg("aircraft_sketch").alias("s"))
    return merged.select("first_hour", "last_hour", "records", F.hll_sketch_estimate("s").alias("aircraft"))


def hour_of_day(points: DataFrame, tz: str) -> DataFrame:
    return points.groupBy(F.hour(local_ts(F.col("ts"), tz)).alias("hour")).agg(F.count_distinct("icao_hex").alias("aircraft"), F.count("*").alias("records"))


def dow_hour_heatmap(points: DataFrame, tz: str) -> DataFrame:
    at = local_ts(F.col("ts"), tz)
    return points.groupBy(day_of_week(at).alias("dow"), F.hour(at).alias("hour")).agg(F.count_distinct("icao_hex").alias("aircraft"))


def peak_hour(points: DataFrame, tz: str) -> DataFrame:
    return hour_of_day(points, tz).agg(F.max_by("hour", F.struct("records", -F.col("hour"))).alias("hour"), F.max("records").alias("records"))


def top_airlines(daily: DataFrame, n: int = 15) -> DataFrame:
    return daily.groupBy("airline").agg(F.sum("flights").alias("flights"), F.sum("records").alias("records")).orderBy(F.col("flights").desc(), "airline").limit(n)


def gate_fill_rate(utilisation: DataFrame, gates: DataFrame) -> DataFrame:
    used, all_ = utilisation.agg(F.count_distinct("gate_id").alias("used")), gates.agg(F.count_distinct("gate_id").alias("gates"))
    return used.crossJoin(all_).withColumn("fill_pct", F.round(F.col("used") * 100 / F.col("gates"), 1))  # one row each


def gate_rankings(utilisation: DataFrame, n: int = 15) -> DataFrame:
    return utilisation.groupBy("gate_id").agg(F.round(F.sum("dwell_minutes"), 2).alias("dwell_minutes"), F.sum("sessions").alias("sessions")).orderBy(F.col("sessions").desc(), "gate_id").limit(n)


def percentile_filter(df: DataFrame, column: str, quantile: float) -> DataFrame:
    """Rows at or above the linear quantile of a column; no values, no rows. Reads ``df`` several times."""
    bound = exact_quantile(df, column, quantile)
    return df.where(F.col(column) >= F.lit(bound))


def scale_to_max(df: DataFrame, column: str) -> DataFrame:
    top = df.agg(F.max(column).alias("_top"))
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(column) / F.col("_top")))
    return df.crossJoin(F.broadcast(top)).withColumn("scaled", F.round(scaled, 6)).drop("_top")  # one row


def tsa_clean(raw: DataFrame) -> DataFrame:
    """Checkpoint rows from text: lenient date and number, hour before the colon; long names dropped."""
    number = F.expr("try_cast(regexp_replace(passengers, ',', '') AS bigint)")
    return raw.where(F.length("checkpoint") < 40).select(F.expr("try_to_date(date, 'MM/dd/yyyy')").alias("day"), F.split_part("hour_of_day", F.lit(":"), F.lit(1)).cast("int").alias("hour"), number.alias("passengers"), "checkpoint")


def tsa_totals(clean: DataFrame, *keys: str) -> DataFrame:
    return clean.where("day IS NOT NULL").groupBy(*keys).agg(F.sum("passengers").alias("passengers"), F.count("*").alias("rows"))


def tsa_kpis(clean: DataFrame) -> DataFrame:
    rows = clean.where("day IS NOT NULL")
    hours = rows.groupBy("hour").agg(F.sum("passengers").alias("p")).agg(F.max_by("hour", F.struct("p", -F.col("hour"))).alias("peak_hour"))
    total = rows.agg(F.sum("passengers").alias("total"), F.round(F.sum("passengers") / F.count_distinct("day"), 2).alias("daily_average"), F.count_distinct("checkpoint").alias("checkpoints"))
    return total.crossJoin(hours)  # one row each


def tsa_heatmap(clean: DataFrame) -> DataFrame:
    return clean.where("day IS NOT NULL").groupBy(day_of_week(F.col("day")).alias("dow"), "hour").agg(F.sum("passengers").alias("passengers"))


def match_rate_trend(legs: DataFrame, results: DataFrame) -> DataFrame:
    met = legs.join(results.select("icao_hex", "service_date", "segment", F.lit(1).alias("hit")), ["icao_hex", "service_date", "segment"], "left")
    return met.groupBy("service_date").agg(F.count("*").alias("legs"), F.count("hit").alias("matched"), F.round(F.count("hit") * 100 / F.count("*"), 1).alias("match_pct"))


def match_method_mix(results: DataFrame) -> DataFrame:
    return results.groupBy("method").agg(F.count("*").alias("legs"), F.round(F.avg("confidence"), 3).alias("confidence"))


def backfill_completeness(points: DataFrame, first: str, last: str) -> DataFrame:
    """Every day of a window with its rows, and whether there are any."""
    days = points.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    have = points.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("rows"))
    return days.join(have, "day", "left").select("day", F.coalesce("rows", F.lit(0)).alias("rows"), F.col("rows").isNotNull().alias("done"))


def traffic_hourly_local(hourly: DataFrame, tz: str) -> DataFrame:
    """Aircraft and records by airport-local hour."""
    return hourly.groupBy(local_ts(F.col("hour"), tz).alias("hour")).agg(F.sum("aircraft").alias("aircraft"), F.sum("records").alias("records"))


def traffic_daily_total(daily: DataFrame) -> DataFrame:
    """Sums over the categories of a day; the averages are means of the categories' means."""
    return daily.groupBy("service_date").agg(
        F.sum("aircraft").alias("aircraft_summed"), F.sum("flights").alias("flights_summed"), F.sum("records").alias("records"),
        F.round(F.avg("avg_altitude"), 2).alias("mean_of_altitudes"), F.round(F.avg("avg_speed"), 2).alias("mean_of_speeds"),
    )


def traffic_by_weekday(daily: DataFrame) -> DataFrame:
    return daily.groupBy(day_of_week(F.col("service_date")).alias("dow")).agg(F.sum("aircraft").alias("aircraft_summed"), F.sum("flights").alias("flights_summed"))


def busiest_day(daily: DataFrame) -> DataFrame:
    """The day with most records (the first of several)."""
    days = daily.groupBy("service_date").agg(F.sum("records").alias("records"))
    return days.orderBy(F.col("records").desc(), "service_date").limit(1)


def airline_delay_stats(delays: DataFrame) -> DataFrame:
    columns = ["delay_minutes", "delayed", "early_minutes", "early"]
    return delays.groupBy("airline_icao").agg(*[F.sum(c).alias(c) for c in columns])


def delay_rankings(delays: DataFrame, n: int = 15) -> DataFrame:
    """The first ``n`` airlines by each of four measures: measure, place (from 1), airline_icao, value."""
    columns = ["delay_minutes", "delayed", "early_minutes", "early"]
    long = airline_delay_stats(delays).unpivot(["airline_icao"], columns, "measure", "value")
    place = F.row_number().over(Window.partitionBy("measure").orderBy(F.col("value").desc(), "airline_icao"))
    return long.withColumn("place", place).where(F.col("place") <= n).select("measure", "place", "airline_icao", "value")


def schedule_vs_actual(schedule: DataFrame, points: DataFrame, airport: str, tz: str, threshold: int) -> DataFrame:
    """Scheduled flights with the first time that any callsign with their number was seen on that day."""
    seen = points.where(fl.tidy(F.col("flight")).isNotNull()).select(F.to_date(local_ts(F.col("ts"), tz)).alias("flight_date"), F.regexp_substr("flight", F.lit("[0-9]+")).alias("flight_number"), "ts")
    first = seen.where("flight_number IS NOT NULL").groupBy("flight_date", "flight_number").agg(F.min("ts").alias("first_seen"))
    direction = fl.schedule_direction(F.upper("dep_airport"), F.upper("arr_airport"), [airport])
    planned = F.when(F.upper("dep_airport") == airport, F.col("dep_scheduled")).otherwise(F.col("arr_scheduled"))
    met = schedule.withColumn("direction", direction).withColumn("scheduled", planned).join(first, ["flight_date", "flight_number"], "left")
    delay = boundaries("minute", F.col("scheduled"), F.col("first_seen"))
    return met.select("schedule_key", "flight_date", "flight_number", "airline_name", "direction", "scheduled", "first_seen", delay.alias("delay_minutes"), fl.delay_status(delay, threshold).alias("status"))


def airline_utilisation(dwell: DataFrame) -> DataFrame:
    return dwell.groupBy("airline_code").agg(F.round(F.sum("dwell_seconds") / 60, 2).alias("dwell_minutes"), F.sum("sessions").alias("sessions"))


def gate_airline_breakdown(dwell: DataFrame) -> DataFrame:
    return dwell.groupBy("gate_id", "airline_code").agg(F.round(F.sum("dwell_seconds") / 60, 2).alias("dwell_minutes"), F.sum("sessions").alias("sessions"))


def airline_gate_pivot(breakdown: DataFrame, gates: list) -> DataFrame:
    """Airlines in rows, the given gates in columns, whole minutes in cells (0 where there are none)."""
    wide = breakdown.where(F.col("gate_id").isin(gates)).groupBy("airline_code").pivot("gate_id", gates).agg(F.round(F.sum("dwell_minutes")).cast("long"))
    return wide.na.fill(0).select("airline_code", *[F.col(str(g)).alias(f"gate_{g}") for g in gates])


def gate_dow_heatmap(at_gates: DataFrame, names: DataFrame, tz: str) -> DataFrame:
    """Dwell minutes by gate and weekday; ``place`` numbers gates in natural order (A1, A2, A10)."""
    spent = at_gates.where("gate_id IS NOT NULL").groupBy("gate_id", day_of_week(local_ts(F.col("ts"), tz)).alias("dow")).agg(F.round(F.sum(F.coalesce("lag_seconds", F.lit(0))) / 60, 2).alias("dwell_minutes"))
    used = spent.select("gate_id").distinct().join(names.select("gate_id", "gate_name"), "gate_id")
    letters, digits = F.regexp_extract("gate_name", "^([^0-9]*)", 1), F.regexp_extract("gate_name", "([0-9]+)", 1).try_cast("long")
    place = F.row_number().over(Window.orderBy(F.lower(letters), digits.asc_nulls_first(), "gate_name", "gate_id"))  # gates of one airport: a few hundred
    return spent.join(used.withColumn("place", place), "gate_id").select("place", "gate_name", "dow", "dwell_minutes")


def tsa_checkpoints(clean: DataFrame) -> DataFrame:
    return clean.where("day IS NOT NULL").select("checkpoint").distinct()


def tsa_raw(clean: DataFrame, first: str, last: str, n: int = 1000) -> DataFrame:
    rows = clean.where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return rows.orderBy(F.col("day").desc(), "hour", "checkpoint", F.col("passengers").desc_nulls_last()).limit(n)


def tsa_geo(clean: DataFrame, places: DataFrame) -> DataFrame:
    """Totals and daily means by checkpoint with its place, and how the place was found (match_type)."""
    totals = clean.where("day IS NOT NULL").groupBy("checkpoint").agg(F.sum("passengers").alias("passengers"), F.count_distinct("day").alias("days"))
    met = totals.join(F.broadcast(places), "checkpoint", "left")
    return met.select("checkpoint", "lat", "lon", F.coalesce("match_type", F.lit("none")).alias("match_type"), "passengers", F.round(F.col("passengers") / F.col("days"), 2).alias("daily_average"))


def tsa_match_types(placed: DataFrame) -> DataFrame:
    return placed.groupBy("match_type").agg(F.count("*").alias("checkpoints"), F.sum("passengers").alias("passengers"))
