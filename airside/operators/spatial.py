"""Spatial joins: an equi-join on grid cells, then the exact distance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airside.functions import geo
from airside.functions.flight import crossing_direction
from airside.functions.time import boundaries
from airside.operators.cover import cover, flag_within, within
from airside.operators.keyed import scope, top_per_key
from airside.sources.files import stored

#: Up to so many positions are broadcast; more are joined by shuffle on the cell.
BROADCAST_PLACES = 200_000
#: Up to so many places' ids (some 24 bytes each) are broadcast as lists by position; more are joined by position.
BROADCAST_IDS = 1_000_000
#: Places of one position that go together.
PIECE = 1000
#: Height of the cells that corridors are covered with.
CORRIDOR_CELL_M = 100.0


def _cells(lat: Column, lon: Column, radius_m: float, south: float) -> tuple[Column, Column]:
    """Cell of a point: rows as high as the radius, columns as wide at latitude ``south`` or nearer the equator."""
    high = radius_m / geo.DEGREE_M
    return geo.cell(lat, high), geo.cell(lon, high / max(math.cos(math.radians(south)), 1e-3))


def _around(places: DataFrame, radius_m: float, most: float) -> DataFrame:
    """Each place in its own cell and the eight around it."""
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    cy, cx = _cells(F.col("lat"), F.col("lon"), radius_m, most)
    kept = [c for c in places.columns if c not in ("lat", "lon")]
    spread = places.select(*kept, F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon"), cy.alias("y"), cx.alias("x"), steps.alias("s"))
    return spread.select(*kept, "g_lat", "g_lon", (F.col("y") + F.col("s.i")).alias("cy"), (F.col("x") + F.col("s.j")).alias("cx"))


def _extent(places: DataFrame, radius_m: float) -> tuple[int, float]:
    """How many places there are, and the highest latitude (either side) within the radius of one."""
    n, most = places.agg(F.count("*"), F.max(F.abs("lat"))).first()
    return n, min(89.9, (most or 0.0) + radius_m / geo.DEGREE_M)


def _pairs_within(points: DataFrame, spots: DataFrame, radius_m: float) -> DataFrame:
    """Pairs of a point and a row of ``spots`` (lat, lon, as g_lat and g_lon, and what else it has) within the radius, with gate_m.

    Cells are at least as wide as the radius at every latitude that has places, so that a point
    meets only the places of its own cell and finds all that are near enough.
    """
    n, most = _extent(spots, radius_m)
    around = _around(spots, radius_m, most)
    around = F.broadcast(around) if n <= BROADCAST_PLACES else around
    cy, cx = _cells(F.col("lat"), F.col("lon"), radius_m, most)
    met = points.withColumn("cy", cy).withColumn("cx", cx).join(around, [*scope(spots), "cy", "cx"])
    metres = geo.distance_m(F.col("lat"), F.col("lon"), F.col("g_lat"), F.col("g_lon"))
    return met.withColumn("gate_m", metres).where(F.col("gate_m") <= radius_m).drop("cy", "cx")


def places_within(points: DataFrame, places: DataFrame, radius_m: float) -> DataFrame:
    """All pairs of a point and a place (gate_id, lat, lon) within the radius, with gate_m.

    Points meet positions, and take over the lists of their places (in pieces of at most PIECE)
    last: distances are worked out once a position, and pairs, which may be very many, need no shuffle.
    """
    spot = [*scope(places), "g_lat", "g_lon"]
    own = places.select(*scope(places), F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon"), "gate_id")
    piece = F.floor((F.row_number().over(Window.partitionBy(*spot).orderBy("gate_id")) - 1) / PIECE).alias("_piece")
    lists = stored(own.select("*", piece).groupBy(*spot, "_piece").agg(F.collect_list(F.struct("gate_id")).alias("_held"), F.count("*").alias("_n")), "places")
    total = lists.agg(F.sum("_n")).first()[0] or 0
    lists = lists.drop("_piece", "_n")
    near = _pairs_within(points, lists.select(*scope(places), F.col("g_lat").alias("lat"), F.col("g_lon").alias("lon")).distinct(), radius_m)
    met = near.join(F.broadcast(lists) if total <= BROADCAST_IDS else lists, spot).drop("g_lat", "g_lon")
    return met.select(*[c for c in met.columns if c != "_held"], F.explode("_held").alias("_one")).withColumn("gate_id", F.col("_one.gate_id")).drop("_one")


def first_places_within(points: DataFrame, places: DataFrame, radius_m: float) -> DataFrame:
    """``places_within`` for the smallest gate_id only of those that have the same positions: the others meet the same points."""
    lists = places.groupBy(*scope(places), "gate_id").agg(F.sort_array(F.collect_list(F.struct("lat", "lon"))).alias("_at"))
    one = lists.groupBy(*scope(places), "_at").agg(F.min("gate_id").alias("gate_id"))
    spots = stored(one.select(*scope(places), "gate_id", F.inline("_at")), "spots")
    return _pairs_within(points, spots, radius_m).drop("g_lat", "g_lon")


def nearest_place(points: DataFrame, key: str | list[str], places: DataFrame, radius_m: float) -> DataFrame:
    """All points with gate_id and gate_m of the nearest place within the radius, or nulls.

    Ties go to the smaller gate_id, so that of places at one position only that of the smallest
    counts. Up to BROADCAST_PLACES positions go to all executors as one array a cell, and each
    point picks its place in its row, without a shuffle; more are joined by cell, and ``key``
    brings the pairs of a point together. Places with an airport_code are those of points with the same one.
    """
    places = stored(places.groupBy(*scope(places), "lat", "lon").agg(F.min("gate_id").alias("gate_id")), "spots")
    n, most = _extent(places, radius_m)
    cy, cx = _cells(F.col("lat"), F.col("lon"), radius_m, most)
    around = _around(places, radius_m, most)
    celled = points.withColumn("cy", cy).withColumn("cx", cx)
    if n <= BROADCAST_PLACES:
        held = around.groupBy(*scope(places), "cy", "cx").agg(F.collect_list(F.struct("gate_id", "g_lat", "g_lon")).alias("_places"))
        far = F.transform("_places", lambda p: F.struct(geo.distance_m(F.col("lat"), F.col("lon"), p["g_lat"], p["g_lon"]).alias("m"), p["gate_id"].alias("g")))
        best = F.array_min(F.filter(far, lambda p: p["m"] <= radius_m))
        met = celled.join(F.broadcast(held), [*scope(places), "cy", "cx"], "left").withColumn("_best", best)
        return met.withColumn("gate_m", F.col("_best.m")).withColumn("gate_id", F.col("_best.g")).drop("cy", "cx", "_places", "_best")
    met = celled.join(around, [*scope(places), "cy", "cx"], "left")
    metres = geo.distance_m(F.col("lat"), F.col("lon"), F.col("g_lat"), F.col("g_lon"))
    near = met.withColumn("gate_m", F.when(metres <= radius_m, metres)).withColumn("gate_id", F.when(F.col("gate_m").isNotNull(), F.col("gate_id")))
    return top_per_key(near, [key] if isinstance(key, str) else key, [F.col("gate_m").asc_nulls_last(), F.col("gate_id").asc_nulls_last()]).drop("cy", "cx", "g_lat", "g_lon")


def runway_stays(points: DataFrame, runways: DataFrame) -> DataFrame:
    """Points (with flight_key) of flights that come into a corridor, once for each such corridor:
    inside, enters, leaves, event (the number of the stay).

    Outside points are needed too, because they end the stays. Points meet corridors by the cells of
    their covers; the distance is worked out in cells on a corridor's edge only. Points of several airports
    (airport_code) meet corridors of their own.
    """
    cells = stored(cover(runways.select(*scope(runways), "runway_id", "line", "radius"), "line", F.col("radius"), CORRIDOR_CELL_M, False), "corridor-cells")
    own = scope(runways)
    flights = points.withColumnRenamed("airport_code", "_airport") if own else points
    close = within(flights, cells, "line", CORRIDOR_CELL_M, False)
    close = (close.where(F.col("_airport") == F.col("airport_code")) if own else close).select(*own, "flight_key", "runway_id").distinct()
    met = flag_within(points.join(close, [*own, "flight_key"]), cells, "line", CORRIDOR_CELL_M, False, "inside", [*own, "runway_id"])
    w = Window.partitionBy(*own, "flight_key", "runway_id").orderBy("ts", "event_id")
    flagged = met.withColumn("enters", F.col("inside") & ~F.coalesce(F.lag("inside").over(w), F.lit(False))).withColumn("leaves", F.col("inside") & ~F.coalesce(F.lead("inside").over(w), F.lit(False)))
    return flagged.withColumn("event", F.sum(F.col("enters").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def runway_crossings(points: DataFrame, runways: DataFrame) -> DataFrame:
    """Stays inside a runway corridor: entry, exit, seconds, chord, midpoint, top speed, direction."""
    order = F.struct("ts", "event_id")
    at = F.struct("lat", "lon")
    found = runway_stays(points, runways).where("inside").groupBy(*scope(runways), "flight_key", "runway_id", "event").agg(
        F.min("ts").alias("t_entry"), F.max("ts").alias("t_exit"), F.max_by(at, F.when(F.col("enters"), order)).alias("a"), F.max_by(at, F.when(F.col("leaves"), order)).alias("z"),
        F.max(F.coalesce("velocity", F.lit(0))).alias("max_speed"),
    )
    chord = F.round(geo.distance_m(F.col("a.lat"), F.col("a.lon"), F.col("z.lat"), F.col("z.lon")), 1)
    return found.select(
        *scope(runways), "flight_key", "runway_id", "event", "t_entry", "t_exit", boundaries("second", F.col("t_entry"), F.col("t_exit")).alias("seconds"), chord.alias("chord_m"), "max_speed",
        crossing_direction(F.col("a.lat"), F.col("z.lat")).alias("direction"), geo.midpoint(F.col("a"), F.col("z")).alias("midpoint"),
    )


def plausible_crossings(crossings: DataFrame, knots: float = 80, seconds: int = 300, metres: float = 500) -> DataFrame:
    return crossings.where((F.col("max_speed") <= knots) & (F.col("seconds") <= seconds) & (F.col("chord_m") <= metres) & (F.col("direction") != "uncertain"))
