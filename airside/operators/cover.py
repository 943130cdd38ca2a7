"""Rings and corridors as grid cells, so that points meet them by an equi-join.

A cell that lies wholly within reach of a shape decides by itself; in a cell on the edge the
exact distance decides; all other cells are left out. Rows of the grid have one height, and in each
row cells are as wide as they are high at its middle, so cells keep their size up to the poles.
Shapes must not cross the 180th meridian.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airside.functions import geo

#: Up to so many cells are broadcast (a few hundred for a ring, a few thousand for a corridor); more are joined by shuffle.
BROADCAST_CELLS = 200_000


def _width(row: Column, degrees: float) -> Column:
    return F.lit(degrees) / F.greatest(F.cos(F.radians((row + 0.5) * degrees)), F.lit(0.001))


def cell_of(lat: Column, lon: Column, cell_m: float) -> tuple[Column, Column]:
    """Row and column of a point's cell."""
    degrees = cell_m / geo.DEGREE_M
    row = F.floor(lat / degrees)
    return row, F.floor(lon / _width(row, degrees))


def cover(shapes: DataFrame, shape: str, reach: Column, cell_m: float, area: bool) -> DataFrame:
    """Cells (cy, cx) of each row of ``shapes`` within ``reach`` metres of its line or, with ``area``, of its ring's area.

    ``full`` cells are wholly within reach and have no ``shape``; the others keep it, and ``reach_m``. All
    other columns stay. Rows without a shape have no cells.
    """
    degrees = cell_m / geo.DEGREE_M
    rows = shapes.where(F.size(shape) > 1).withColumn("reach_m", reach.cast("double")).withColumn("_b", geo.bounds(F.col(shape))).withColumn("_pad", F.col("reach_m") / geo.DEGREE_M * 1.02 + degrees)
    top = F.least(F.lit(90.0), F.greatest(F.abs(F.col("_b.min_lat")), F.abs(F.col("_b.max_lat"))) + F.col("_pad"))
    rows = rows.withColumn("_wide", F.col("_pad") / F.greatest(F.cos(F.radians(top)), F.lit(0.001)))
    first, last = F.floor((F.col("_b.min_lat") - F.col("_pad")) / degrees), F.floor((F.col("_b.max_lat") + F.col("_pad")) / degrees)
    rows = rows.withColumn("cy", F.explode(F.sequence(first, last))).withColumn("_w", _width(F.col("cy"), degrees))
    west, east = F.floor((F.col("_b.min_lon") - F.col("_wide")) / F.col("_w")), F.floor((F.col("_b.max_lon") + F.col("_wide")) / F.col("_w"))
    cells = rows.withColumn("cx", F.explode(F.sequence(west, east)))
    lat, lon = (F.col("cy") + 0.5) * degrees, (F.col("cx") + 0.5) * F.col("_w")
    away = (geo.distance_to_polygon_m if area else geo.distance_to_line_m)(lat, lon, F.col(shape))
    # Distances are taken in a plane around a point: those of a cell's points and of its middle differ by the slack.
    nearer = F.cos(F.radians(F.greatest(F.abs(lat) - degrees / 2, F.lit(0.0))))
    half = F.sqrt(F.pow(F.col("_w") * nearer, 2) + F.lit(degrees * degrees)) * (geo.DEGREE_M / 2 * 1.01)
    cells = cells.withColumn("_d", away).withColumn("_h", half).withColumn("_all", F.col("_d") + F.col("_h") + F.col("reach_m"))
    slack = F.lit(0.5) + F.col("_all") * 0.001 + F.col("_all") * F.col("_all") * F.abs(F.tan(F.radians(F.least(F.abs(lat), F.lit(89.9))))) / geo.EARTH_M
    cells = cells.withColumn("_s", slack).where(F.col("_d") - F.col("_h") - F.col("_s") <= F.col("reach_m"))
    full = F.col("_d") + F.col("_h") + F.col("_s") <= F.col("reach_m")
    cells = cells.withColumn("full", full).withColumn(shape, F.when(~F.col("full"), F.col(shape)))
    return cells.drop("_b", "_pad", "_wide", "_w", "_d", "_h", "_all", "_s")


def ring_cover(spark: SparkSession, ring: Column, reach_m: float) -> DataFrame:
    """The cover of one ring given as a literal, with cells a sixteenth as high as its reach is wide."""
    return cover(spark.range(1).select(ring.alias("ring")), "ring", F.lit(reach_m), max(reach_m / 8, 50.0), True)


def _met(points: DataFrame, cells: DataFrame, cell_m: float, how: str, keys: list[str]) -> DataFrame:
    row, column = cell_of(F.col("lat"), F.col("lon"), cell_m)
    held = F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells
    return points.withColumn("cy", row).withColumn("cx", column).join(held, [*keys, "cy", "cx"], how).drop("cy", "cx")


def _inside(shape: str, area: bool) -> Column:
    away = (geo.distance_to_polygon_m if area else geo.distance_to_line_m)(F.col("lat"), F.col("lon"), F.col(shape))
    return F.when(F.col("full"), True).otherwise(away <= F.col("reach_m"))


def within(points: DataFrame, cells: DataFrame, shape: str, cell_m: float, area: bool) -> DataFrame:
    """Points (lat, lon) with the columns of each shape that they are within reach of; the others are left out."""
    return _met(points, cells, cell_m, "inner", []).where(_inside(shape, area)).drop(shape, "reach_m", "full")


def flag_within(points: DataFrame, cells: DataFrame, shape: str, cell_m: float, area: bool, name: str, keys: list[str] | None = None) -> DataFrame:
    """All points with the flag ``name``: within reach of the cover's shape; of that with the same ``keys``, if it has several.

    A point without a position is not within reach.
    """
    found = _met(points, cells.select(*(keys or []), "cy", "cx", shape, "reach_m", "full"), cell_m, "left", keys or [])
    return found.withColumn(name, F.coalesce(_inside(shape, area), F.lit(False))).drop(shape, "reach_m", "full")


def near_ring(points: DataFrame, ring: Column, reach_m: float, name: str) -> DataFrame:
    """All points with the flag ``name``: within ``reach_m`` of the area of one ring."""
    return flag_within(points, ring_cover(points.sparkSession, ring, reach_m), "ring", max(reach_m / 8, 50.0), True, name)
