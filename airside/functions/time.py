"""Dates and times. All timestamps are without zone and mean UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_ts(ts: Column, tz: str | Column | None) -> Column:
    """UTC to airport-local time; a blank zone is UTC."""
    zone = tz if isinstance(tz, Column) else F.lit(tz)
    return F.convert_timezone(F.lit("UTC"), F.coalesce(F.nullif(F.trim(zone), F.lit("")), F.lit("UTC")), ts)


def service_date(ts: Column, tz: str | Column | None) -> Column:
    """The airport-local day of a UTC time."""
    return F.to_date(local_ts(ts, tz))


def boundaries(unit: str, start: Column, end: Column) -> Column:
    """Boundaries of ``unit`` crossed from start to end (00:00:59 to 00:01:00 crosses a minute)."""
    return F.timestamp_diff(unit, F.date_trunc(unit, start).cast("timestamp_ntz"), F.date_trunc(unit, end).cast("timestamp_ntz"))


def day_of_week(ts: Column) -> Column:
    """Sunday is 0."""
    return F.dayofweek(ts) - 1
