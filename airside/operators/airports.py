"""Points of many airports in one run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airside.operators.cover import cover, within

#: How far around its ring an airport's points reach.
REACH_M = 50_000.0
CELL_M = 6_250.0


def of_airports(points: DataFrame, airports: DataFrame, reach_m: float = REACH_M) -> DataFrame:
    """Points with airport_code and tz of each airport (airport_code, tz, ring) whose ring they are within reach of.

    Points near none are left out; a point near two airports is a row for each. Sessions, legs, gates,
    traffic and crossings of such points are the airport's own: their operators take the zone as a column (``tz``)
    and have airport_code among their keys. Airports are covered by cells, so points meet them by an equi-join.
    """
    cells = cover(airports.select("airport_code", "tz", "ring"), "ring", F.lit(reach_m), CELL_M, True)
    return within(points.drop("airport_code", "tz"), cells, "ring", CELL_M, True)
