"""Scalar rules on positions, callsigns and schedules, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of the emitter categories, and which of all labels are aircraft.
CATEGORY_LABELS = {"A7": "HELICOPTER", "A5": "HEAVY_AIRCRAFT", "A3": "LARGE_AIRLINER", "A2": "SMALL_COMMUTER", "A1": "LIGHT_AIRCRAFT", "A0": "MEDIUM_AIRCRAFT", "A6": "HIGH_PERFORMANCE_MILITARY"}
AIRCRAFT_LABELS = ["HELICOPTER", "HEAVY_AIRCRAFT", "LARGE_AIRLINER", "MEDIUM_AIRCRAFT", "SMALL_COMMUTER", "LIGHT_AIRCRAFT", "HIGH_PERFORMANCE_MILITARY", "ULTRALIGHT_EXPERIMENTAL"]


def tidy(c: Column) -> Column:
    """Trimmed text; blank is null."""
    return F.nullif(F.trim(c), F.lit(""))


def flight_id(callsign: Column, hex_code: Column) -> Column:
    return F.coalesce(tidy(callsign), hex_code)


def is_ground_leg(speed: Column, altitude: Column) -> Column:
    """Slow, and low or of unknown altitude."""
    return (F.coalesce(speed, F.lit(0)) <= 40) & (altitude.isNull() | (altitude <= 50))


def is_ground_gate(speed: Column, altitude: Column) -> Column:
    """Slow, and known to be low."""
    return altitude.isNotNull() & (altitude <= 50) & (F.coalesce(speed, F.lit(0)) <= 40)


def vehicle_category(category: Column, kind: Column) -> Column:
    """Label by emitter category, then by vehicle type; aircraft come first."""
    known = F.lit(None).cast("string")
    for code, label in CATEGORY_LABELS.items():
        known = F.when(category == code, label).otherwise(known)
    surface = F.when(kind == "TWR", "TOWER").when(kind.isin("SERV", "CAR"), "SERVICE_VEHICLE").when(category == "C1", "LIGHT_SURFACE_VEHICLE").when(category == "C2", "GROUND_VEHICLE").when(category == "C0", "UNKNOWN_SURFACE")
    return F.coalesce(known, F.when(category.startswith("B"), "ULTRALIGHT_EXPERIMENTAL"), surface, F.lit("OTHER"))


def aircraft_only(label: Column, value: Column) -> Column:
    return F.when(label.isin(AIRCRAFT_LABELS), value)


def vehicle_filter(label: Column, chosen: list[str]) -> Column:
    """No choice selects nothing."""
    return label.isin(chosen) if chosen else F.lit(False)


def callsign_base(callsign: Column) -> Column:
    """Upper-case, without one closing W, J, X, Y or Z."""
    return F.regexp_replace(F.upper(F.trim(callsign)), "[WJXYZ]$", "")


def callsign_prefix(callsign: Column) -> Column:
    return F.regexp_substr(callsign_base(callsign), F.lit("^[A-Z]{2,3}"))


def callsign_number(callsign: Column) -> Column:
    return F.regexp_substr(callsign_base(callsign), F.lit("[0-9]+"))


def callsign_key(callsign: Column) -> Column:
    """Two or three leading letters with the digits that follow."""
    return F.regexp_substr(F.upper(F.trim(callsign)), F.lit("^[A-Z]{2,3}[0-9]+"))


def flight_key(hex_code: Column, callsign: Column, ts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.coalesce(hex_code, F.lit("")), F.coalesce(callsign, F.lit("")), F.date_format(ts, "yyyyMMddHH")))


def aircraft_day_id(hex_code: Column, day: Column) -> Column:
    return F.md5(F.concat(hex_code, F.lit(":"), day.cast("string")))


def flight_phase(altitude: Column, speed: Column) -> Column:
    low = F.when(speed < 50, "Ground").otherwise("Takeoff/Landing")
    middle = F.when(speed > 200, "Climbing").otherwise("Descending")
    high = F.when(speed < 100, "Descending").otherwise("Cruise")
    known = F.when(altitude < 1000, low).when(altitude < 10000, middle).otherwise(high)
    return F.when(altitude.isNull() | speed.isNull(), "Unknown").otherwise(known)


def altitude_band(altitude: Column) -> Column:
    return F.when(altitude < 10000, "low").when(altitude < 25000, "medium").when(altitude < 35000, "high").when(altitude.isNotNull(), "very_high").otherwise("unknown")


def speed_band(speed: Column) -> Column:
    return F.when(speed < 200, "slow").when(speed < 400, "medium").when(speed.isNotNull(), "fast").otherwise("unknown")


def delay_status(minutes: Column, threshold: int) -> Column:
    return F.when(minutes.isNull(), "Unknown").when(F.abs(minutes) <= threshold, "On Time").when(minutes < -threshold, "Arrived Earlier").otherwise("Arrived Later")


def freshness_status(minutes: Column) -> Column:
    return F.when(minutes.isNull(), "Unknown").when(minutes <= 5, "Fresh").when(minutes <= 30, "OK").otherwise("Stale")


def crossing_direction(entry_lat: Column, exit_lat: Column, least: float = 0.00005) -> Column:
    move = exit_lat - entry_lat
    return F.when(move > least, "S→N").when(move < -least, "N→S").otherwise("uncertain")


def schedule_direction(departure: Column, arrival: Column, codes: list[str]) -> Column:
    return F.when(departure.isin(codes), "departure").when(arrival.isin(codes), "arrival").otherwise("unknown")


def planned(direction: Column, departing: Column, arriving: Column) -> Column:
    """The departure's value of a departure, the arrival's of an arrival (gate, terminal)."""
    return F.when(direction == "departure", departing).when(direction == "arrival", arriving)


def table_freshness(hours: Column, most: int = 2) -> Column:
    """OK up to ``most`` hours, else STALE; nothing at all is STALE."""
    return F.when(hours <= most, "OK").otherwise("STALE")


def display_name(code: Column, name: Column, longest_code: int = 3) -> Column:
    """The name of a code; what is longer than a code is a name already and only gets capitals."""
    return F.when(F.length(code) > longest_code, F.initcap(code)).otherwise(F.coalesce(name, code))


def aggregation_divisor(kind: str, first: str, last: str) -> Column:
    """By what sums over a period are divided: 1 (``sum``), or its days (``daily_average``)."""
    return F.lit(1) if kind == "sum" else F.greatest(F.lit(1), F.date_diff(F.lit(last).cast("date"), F.lit(first).cast("date")) + 1)
