"""Flight schedules: parsing payloads, the canonical table, and finding the schedule of a flight."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airside.functions import flight as fl
from airside.operators.keyed import top_per_key

_END = "struct<iata: string, scheduled: string, estimated: string, actual: string, delay: int, terminal: string, gate: string>"
_CODESHARE = "struct<airline_name: string, flight_iata: string>"
PAYLOAD = f"""struct<data: array<struct<
  flight_status: string,
  flight: struct<number: string, iata: string, icao: string, codeshared: {_CODESHARE}>,
  departure: {_END}, arrival: {_END},
  airline: struct<name: string, iata: string, icao: string>,
  aircraft: struct<registration: string, iata: string, icao: string>>>>"""

#: Columns that a later payload may change on a known flight.
CHANGING = ["flight_status", "dep_estimated", "dep_actual", "dep_delay", "arr_estimated", "arr_actual", "arr_delay", "updated_at"]


def utc_time(text: Column, tz: str) -> Column:
    """UTC time of a text: as its offset says, or from airport-local time without one; else null."""
    with_offset = text.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    instant = F.try_to_timestamp(text).cast("timestamp_ntz")  # wall clock of the session's zone
    local = F.try_to_timestamp(F.regexp_replace(text, "T", " ")).cast("timestamp_ntz")
    return F.when(with_offset, F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant)).otherwise(F.convert_timezone(F.lit(tz), F.lit("UTC"), local))


def _side(name: str, short: str, tz: str) -> list[Column]:
    at = lambda f: F.col(f"f.{name}.{f}")
    times = [utc_time(at(t), tz).alias(f"{short}_{t}") for t in ("scheduled", "estimated", "actual")]
    return [at("iata").alias(f"{short}_airport"), *times, at("delay").alias(f"{short}_delay"), at("terminal").alias(f"{short}_terminal"), at("gate").alias(f"{short}_gate")]


def schedule_parse(payloads: DataFrame, tz: str) -> DataFrame:
    """Flights of API payloads (flight_date, value, ingested_at), one row for each IATA code and departure.

    A missing flight code is made of the airline's code and the number. Texts that don't parse
    have no flights. Of several payloads with one flight the last ingested counts; of those the
    one with the later arrival, registration and so on through all columns, so that no tie is open.
    """
    f = payloads.select("flight_date", "ingested_at", F.explode(F.from_json("value", PAYLOAD)["data"]).alias("f"))
    code = lambda own, airline: F.coalesce(fl.tidy(F.col(f"f.flight.{own}")), F.concat(F.upper(F.trim(F.col(f"f.airline.{airline}"))), F.trim("f.flight.number")))
    flat = f.select(
        "flight_date", F.col("f.flight_status").alias("flight_status"), *_side("departure", "dep", tz), *_side("arrival", "arr", tz),
        F.col("f.airline.name").alias("airline_name"), F.col("f.airline.iata").alias("airline_iata"), F.col("f.airline.icao").alias("airline_icao"),
        F.col("f.flight.number").alias("flight_number"), code("iata", "iata").alias("flight_iata"), code("icao", "icao").alias("flight_icao"),
        F.col("f.aircraft.registration").alias("sched_registration"), F.col("f.flight.codeshared.airline_name").alias("codeshare_airline"),
        F.col("f.flight.codeshared.flight_iata").alias("codeshare_flight_iata"), F.col("ingested_at").alias("updated_at"),
    )
    last = [F.col("updated_at").desc(), F.col("arr_scheduled").desc_nulls_last(), F.col("sched_registration").desc_nulls_last(), F.col("flight_icao").asc_nulls_last()]
    return top_per_key(flat, ["flight_iata", "dep_scheduled"], [*last, *_rest(flat, ["flight_iata", "dep_scheduled", "updated_at", "arr_scheduled", "sched_registration", "flight_icao"])])


def _rest(rows: DataFrame, named: list[str]) -> list[Column]:
    """An order of all columns that aren't ``named``: it settles what ties an order before leaves."""
    return [F.col(c).asc_nulls_last() for c in rows.columns if c not in named]


def is_codeshare(codeshare_airline: Column) -> Column:
    return codeshare_airline.isNotNull()


def schedule_key(iata: Column, departure: Column, arrival: Column) -> Column:
    """md5 of code and scheduled times; what is missing counts as UNKNOWN."""
    shown = lambda t: F.coalesce(F.date_format(t, "yyyy-MM-dd HH:mm:ss"), F.lit("UNKNOWN"))
    return F.md5(F.concat_ws(":", F.coalesce(iata, F.lit("UNKNOWN")), shown(departure), shown(arrival)))


def schedule_etl_upsert(target: DataFrame, batch: DataFrame) -> DataFrame:
    """The canonical schedule after a batch of parsed flights.

    The newest row of each key counts. A known flight takes over CHANGING columns, a new one is
    added whole. Running it twice changes nothing.
    """
    keyed = batch.withColumn("flight_key", schedule_key(F.col("flight_iata"), F.col("dep_scheduled"), F.col("arr_scheduled"))).withColumn("is_codeshare", is_codeshare(F.col("codeshare_airline")))
    own = keyed.select(*target.columns)
    newest = top_per_key(own, ["flight_key"], [F.col("updated_at").desc(), F.col("flight_number").asc_nulls_last(), *_rest(own, ["flight_key", "updated_at", "flight_number"])])
    t, b = target.alias("t"), newest.alias("b")
    both = t.join(b, F.col("t.flight_key") == F.col("b.flight_key"), "full")
    matched, known = F.col("b.flight_key").isNotNull(), F.col("t.flight_key").isNotNull()
    pick = lambda c: F.when(matched & (~known | F.lit(c in CHANGING)), F.col(f"b.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
    return both.select(*[pick(c) for c in target.columns])


def code_translation_join(flights: DataFrame, code_map: DataFrame, prefix: str = "prefix") -> DataFrame:
    """``other_code``: the code of the other kind for a prefix of three letters (ICAO) or two (IATA).

    A code may have several partners, each in a row of its own. ``code_map`` (airline_iata,
    airline_icao) is a dimension of a few thousand rows.
    """
    by_icao = code_map.select(F.col("airline_icao").alias(prefix), F.col("airline_iata").alias("other_code"))
    by_iata = code_map.select(F.col("airline_iata").alias(prefix), F.col("airline_icao").alias("other_code"))
    return flights.join(by_icao.unionByName(by_iata).distinct(), prefix, "left")


def _days(schedule: DataFrame) -> DataFrame:
    """Each schedule row on its day and the days beside it."""
    return schedule.withColumn("on_date", F.explode(F.array(*[F.date_add("flight_date", d) for d in (-1, 0, 1)])))


def schedule_for_flight(flights: DataFrame, schedule: DataFrame, by_number: bool = True) -> DataFrame:
    """The best schedule row of each (flight_id, on_date): exact ICAO code, exact IATA code, then
    number and airline prefix (unless not ``by_number``); then the nearest day, then the newest.

    Every way is an equi-join of its own. Flights without a schedule row are left out.
    """
    ids = flights.select("flight_id", "on_date").distinct()
    ids = ids.withColumn("code", F.upper(F.trim("flight_id"))).withColumn("prefix", F.regexp_substr("code", F.lit("^[A-Z]{2,3}"))).withColumn("number", F.regexp_substr("code", F.lit("[0-9]+")))
    days = _days(schedule)
    ways = [
        ids.join(days.withColumn("code", F.upper(F.trim("flight_icao"))), ["code", "on_date"]).withColumn("match_rank", F.lit(0)),
        ids.join(days.withColumn("code", F.upper(F.trim("flight_iata"))), ["code", "on_date"]).withColumn("match_rank", F.lit(1)),
    ]
    if by_number:
        for airline, size in (("airline_icao", 3), ("airline_iata", 2)):
            keyed = days.withColumn("number", F.col("flight_number")).withColumn("prefix", F.upper(F.trim(airline)))
            ways.append(ids.where(F.length("prefix") == size).join(keyed, ["prefix", "number", "on_date"]).withColumn("match_rank", F.lit(2)))
    met = reduce(DataFrame.unionByName, [w.select("flight_id", "on_date", "match_rank", *schedule.columns) for w in ways])
    met = met.withColumn("date_diff", F.abs(F.date_diff("flight_date", "on_date")))
    order = [F.col("match_rank").asc(), F.col("date_diff").asc(), F.col("updated_at").desc(), F.col("schedule_key").asc()]
    return top_per_key(met, ["flight_id", "on_date"], order)


def flight_headers(flight_ids: DataFrame, schedule: DataFrame) -> DataFrame:
    """Airline, origin, destination and number of flights (flight_id, on_date), by exact codes only."""
    best = schedule_for_flight(flight_ids, schedule, by_number=False)
    return best.select("flight_id", "on_date", "airline_name", F.col("dep_airport").alias("origin_airport"), F.col("arr_airport").alias("destination_airport"), F.col("flight_number").alias("schedule_flight_number"))


def airline_name_map(schedule: DataFrame, airlines: DataFrame) -> DataFrame:
    """code, airline_name for ICAO and IATA codes: the schedule's name first, else the dimension's."""

    def names(rows: DataFrame) -> DataFrame:
        codes = F.explode(F.array(F.upper(F.trim("airline_icao")), F.upper(F.trim("airline_iata"))))
        pairs = rows.select(codes.alias("code"), fl.tidy(F.col("airline_name")).alias("airline_name"))
        return pairs.where("code <> '' AND airline_name IS NOT NULL").groupBy("code").agg(F.max("airline_name").alias("airline_name"))

    own, other = names(schedule), names(airlines).withColumnRenamed("airline_name", "other")
    return own.join(other, "code", "full").select("code", F.coalesce("airline_name", "other").alias("airline_name"))
