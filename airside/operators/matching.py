"""Matching flight legs to the schedule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airside.functions import flight as fl
from airside.functions.time import boundaries
from airside.operators.keyed import top_per_key
from airside.operators.schedules import code_translation_join

REGISTRATION_MINUTES, CALLSIGN_MINUTES = 240, 2160
#: To how many partitions the legs of one callsign and day go.
DEALT = 4


def _by_day(schedule: DataFrame) -> DataFrame:
    """Each schedule row on its day and the days beside it: a range join as an equi-join."""
    return schedule.withColumn("on_date", F.explode(F.array(*[F.date_add("flight_date", d) for d in (-1, 0, 1)])))


#: What a schedule row's codes are made of.
_CODED = ["flight_icao", "flight_iata", "airline_icao", "airline_iata", "flight_number"]


def _with_codes(schedule: DataFrame) -> DataFrame:
    """Adds ``_codes``: all codes of a schedule row, in order."""
    codes = F.array("flight_icao", "flight_iata", F.concat("airline_icao", "flight_number"), F.concat("airline_iata", "flight_number"))
    return schedule.withColumn("_codes", F.array_sort(F.array_distinct(F.array_compact(codes))))


def _named(schedule: DataFrame, callsigns: DataFrame, code_map: DataFrame | None) -> DataFrame:
    """callsign, _codes: which lists of codes each callsign stands for, a row for each two. There are as many
    lists as flights of differing codes, however many legs and days have them."""
    names = callsigns.distinct().withColumn("prefix", fl.callsign_prefix(F.col("callsign"))).withColumn("number", fl.callsign_number(F.col("callsign")))
    key = F.explode(F.array_distinct(F.array_compact(F.array(F.upper(F.trim("callsign")), fl.callsign_base(F.col("callsign")), F.concat("prefix", "number")))))
    keys = names.select("callsign", key.alias("_code"))
    if code_map is not None:
        translated = code_translation_join(names, code_map).where("other_code IS NOT NULL")
        keys = keys.unionByName(translated.select("callsign", F.concat("other_code", "number").alias("_code")))
    lists = _with_codes(schedule.select(*_CODED).distinct()).select("_codes").distinct()
    return keys.join(lists.withColumn("_code", F.explode("_codes")), "_code").select("callsign", "_codes").distinct()


def _by_registration(legs: DataFrame, schedule: DataFrame) -> DataFrame:
    days = _by_day(schedule.where("sched_registration IS NOT NULL"))
    return legs.join(days, (F.col("registration") == F.col("sched_registration")) & (F.col("service_date") == F.col("on_date"))).withColumn("method", F.lit("registration_time"))


def _by_callsign(legs: DataFrame, schedule: DataFrame, code_map: DataFrame | None) -> DataFrame:
    """Each leg and schedule row once, whatever codes they share, so that pairs need no shuffle.

    Pairs are many where their legs and rows are few bytes, so both are dealt to all partitions, which
    adaptive execution would else make few of, and the legs of one callsign and day to DEALT of them.
    """
    named = _named(schedule, legs.select("callsign"), code_map).withColumnRenamed("callsign", "_callsign")
    n = int(legs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = legs.join(named, F.col("callsign") == F.col("_callsign")).withColumn("_part", F.pmod(F.xxhash64("start_ts", "end_ts"), F.lit(DEALT)).cast("int"))
    days = _by_day(_with_codes(schedule)).withColumnRenamed("_codes", "_own").withColumn("_copy", F.explode(F.array(*[F.lit(i) for i in range(DEALT)])))
    own, days = own.repartition(n, "_codes", "service_date", "_part"), days.repartition(n, "_own", "on_date", "_copy")
    met = own.join(days.hint("merge"), (F.col("_codes") == F.col("_own")) & (F.col("service_date") == F.col("on_date")) & (F.col("_part") == F.col("_copy")))
    return met.drop("_callsign", "_codes", "_own", "_part", "_copy").withColumn("method", F.lit("callsign_time"))


def _minutes(rows: DataFrame, **columns: str) -> DataFrame:
    """Adds minutes of times as numbers, so that pairs only subtract them."""
    return rows.withColumns({n: boundaries("minute", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c)) for n, c in columns.items()})


def _pairs(join: Callable[[DataFrame, DataFrame], DataFrame], legs: DataFrame, schedule: DataFrame) -> DataFrame:
    """Pairs of a join with their gap in minutes, if it isn't too wide."""
    pairs = join(_minutes(legs, _s="start_ts", _e="end_ts"), _minutes(schedule, _d="dep_scheduled", _a="arr_scheduled"))
    departing, arriving = F.col("_s") - F.col("_d"), F.col("_e") - F.col("_a")
    either = F.when(departing.isNotNull() & arriving.isNotNull(), F.least(F.abs(departing), F.abs(arriving)))
    gap = F.when(F.col("direction") == "departure", departing).when(F.col("direction") == "arrival", arriving).otherwise(either)
    limit = F.when(F.col("method") == "registration_time", REGISTRATION_MINUTES).otherwise(CALLSIGN_MINUTES)
    return pairs.withColumn("gap", gap).where(F.abs("gap") <= limit).drop("_s", "_e", "_d", "_a")


def match_candidates(legs: DataFrame, schedule: DataFrame, code_map: DataFrame | None = None) -> DataFrame:
    """Legs with the schedule rows of the same registration, or of the same callsign by code or
    by airline prefix and number; each condition is an equi-join of its own. With ``code_map``
    (airline_iata, airline_icao) a prefix also stands for the airline's other code.

    All pairs are rows: their number grows with the square of the legs and rows of one callsign
    and day. ``best_matches`` does without them. Pairs leave the joins as they are, unshuffled.
    """
    return _pairs(_by_registration, legs, schedule).unionByName(_pairs(lambda a, b: _by_callsign(a, b, code_map), legs, schedule))


def match_score(candidates: DataFrame, codes: list[str]) -> DataFrame:
    """direction_ok, day_diff and score: by time gap, less 10 a day and 30 for a wrong airport."""
    d = F.abs("gap")
    by_registration = F.greatest(F.lit(0), F.round(100 - d * 100 / REGISTRATION_MINUTES))
    tier = F.when(d <= 120, 90 - d * 10 / 120).when(d <= 1440, 79 - (d - 120) * 19 / 1320).otherwise(59 - (d - 1440) * 19 / 720)
    base = F.when(F.col("method") == "registration_time", by_registration).otherwise(F.greatest(F.lit(0), F.round(tier)))
    airport = F.when(F.col("direction") == "departure", F.col("dep_airport")).when(F.col("direction") == "arrival", F.col("arr_airport"))
    tested = F.col("direction").isin("departure", "arrival")
    ok = F.when(tested, airport.isin(codes)).otherwise(F.lit(True))
    days = F.abs(F.date_diff("service_date", "flight_date"))
    wrong = F.when(tested & ~F.coalesce(ok, F.lit(True)), 30).otherwise(0)
    return candidates.withColumn("direction_ok", ok).withColumn("day_diff", days).withColumn("score", (base - 10 * days - wrong).cast("int"))


_LEG = ["icao_hex", "service_date", "segment"]


def match_result(scored: DataFrame) -> DataFrame:
    """The best schedule row of each leg; confidence doesn't fall below 0."""
    return _chosen(scored.select(*_LEG, _place()))


def _place() -> Column:
    """What puts the best pair first, as a struct: its least is the best; schedule rows that are alike go by their key."""
    ok = F.when(F.col("direction_ok").isNull(), 0).when(F.col("direction_ok"), 1).otherwise(2)
    order = [(F.col("method") != "registration_time").alias("other"), ok.alias("way"), (-F.col("score")).alias("less"), F.abs("gap").alias("time_gap"), "day_diff", "schedule_key", "method", "direction_ok", "score"]
    return F.struct(*order).alias("_best")


def _chosen(placed: DataFrame) -> DataFrame:
    best = placed.groupBy(*_LEG).agg(F.min("_best").alias("_best")).select(*_LEG, "_best.*")
    return best.select(*_LEG, "schedule_key", "method", "direction_ok", "score", F.greatest("score", F.lit(0)).alias("confidence"), "time_gap", "day_diff")


def best_matches(legs: DataFrame, schedule: DataFrame, codes: list[str], code_map: DataFrame | None = None) -> DataFrame:
    """``match_result`` of all scored candidates, without a row for each pair of a callsign.

    Legs of one callsign, day and direction that begin and end in the same minutes (of which a
    departure's end and an arrival's beginning don't count) have the same best row, and of schedule
    rows alike in codes, day, airports and minutes only that of least key can be it. So one of each
    is paired: by callsign and day there are no more than the minutes of a day allow.
    """
    minute = lambda c: F.date_trunc("minute", c).cast("timestamp_ntz")
    begins, ends = (F.when(~F.col("direction").eqNullSafe(d), minute(c)) for d, c in (("arrival", "start_ts"), ("departure", "end_ts")))
    alike = ["callsign", "service_date", "direction", "start_ts", "end_ts"]
    short = legs.where("callsign IS NOT NULL").select(*_LEG, "callsign", "direction", begins.alias("start_ts"), ends.alias("end_ts"))
    same = [*_CODED, "flight_date", "dep_airport", "arr_airport", "dep_scheduled", "arr_scheduled"]
    times = schedule.withColumns({c: minute(c) for c in ("dep_scheduled", "arr_scheduled")})
    rows = times.groupBy(*same).agg(F.min(F.struct("schedule_key")).alias("_k")).select(*same, "_k.schedule_key")
    called = match_score(_pairs(lambda a, b: _by_callsign(a, b, code_map), short.select(*alike).distinct(), rows), codes).select(*alike, _place())
    found = called.groupBy(*alike).agg(F.min("_best").alias("_best")).select(*[F.col(c).alias(f"_{c}") for c in alike], "_best")
    by_callsign = short.join(found, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in alike]).select(*_LEG, "_best")
    by_registration = match_score(_pairs(_by_registration, legs, schedule), codes).select(*_LEG, _place())
    return _chosen(by_registration.unionByName(by_callsign))


def callsign_prior(legs: DataFrame, results: DataFrame, schedule: DataFrame, least: int, since: str | None = None) -> DataFrame:
    """For callsign keys with at least ``least`` matched legs (from day ``since`` on), the most
    frequent airline, and the most frequent origin and destination of the legs that have both."""
    recent = legs if since is None else legs.where(F.col("service_date") >= F.lit(since).cast("date"))
    keyed = recent.withColumn("callsign_key", fl.callsign_key(F.col("callsign"))).where("callsign_key IS NOT NULL")
    won = results.select("icao_hex", "service_date", "segment", "schedule_key")
    flights = schedule.select("schedule_key", "airline_icao", "airline_iata", "airline_name", "dep_airport", "arr_airport")
    matched = keyed.join(won, ["icao_hex", "service_date", "segment"]).join(flights, "schedule_key")
    counted = matched.groupBy("callsign_key", "airline_icao", "airline_iata").agg(F.count("*").alias("n"), F.max("airline_name").alias("airline_name"))
    totals = counted.groupBy("callsign_key").agg(F.sum("n").alias("total_legs")).where(F.col("total_legs") >= least)
    modal = top_per_key(counted, ["callsign_key"], [F.col("n").desc(), F.col("airline_icao").asc_nulls_last(), F.col("airline_iata").asc_nulls_last()])
    ways = matched.where("dep_airport IS NOT NULL AND arr_airport IS NOT NULL").groupBy("callsign_key", F.col("dep_airport").alias("origin_airport"), F.col("arr_airport").alias("destination_airport")).agg(F.count("*").alias("times"))
    way = top_per_key(ways, ["callsign_key"], [F.col("times").desc(), F.col("origin_airport").asc(), F.col("destination_airport").asc()]).drop("times")
    full = modal.join(totals, "callsign_key").join(way, "callsign_key", "left")
    return full.select("callsign_key", "airline_icao", "airline_iata", "airline_name", "n", "total_legs", "origin_airport", "destination_airport")
