"""Distances and cells from built-in functions: points are lon/lat doubles, lines and rings
arrays of struct<lon,lat>."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371000.0
DEGREE_M = EARTH_M * math.pi / 180


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def _edges(line: Column) -> Column:
    n = F.size(line)
    return F.zip_with(F.slice(line, F.lit(1), n - 1), F.slice(line, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def distance_to_line_m(lat: Column, lon: Column, line: Column) -> Column:
    """Metres to the nearest segment, in a local plane around the point."""

    def to_edge(e: Column) -> Column:
        shrink = F.cos(F.radians(lat))
        ax, ay = (e["a"]["lon"] - lon) * shrink * DEGREE_M, (e["a"]["lat"] - lat) * DEGREE_M
        bx, by = (e["b"]["lon"] - lon) * shrink * DEGREE_M, (e["b"]["lat"] - lat) * DEGREE_M
        dx, dy = bx - ax, by - ay
        square = dx * dx + dy * dy
        t = F.when(square == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / square)))
        return F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2))

    return F.array_min(F.transform(_edges(line), to_edge))


def in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Whether a ray to the east meets the closed ring an odd number of times."""

    def crosses(e: Column) -> Column:
        over = (e["a"]["lat"] > lat) != (e["b"]["lat"] > lat)
        at = e["a"]["lon"] + (lat - e["a"]["lat"]) / F.nullif(e["b"]["lat"] - e["a"]["lat"], F.lit(0.0)) * (e["b"]["lon"] - e["a"]["lon"])
        return F.when(over & (lon < at), 1).otherwise(0)

    return F.aggregate(F.transform(_edges(ring), crosses), F.lit(0), lambda s, x: s + x) % 2 == 1


def distance_to_polygon_m(lat: Column, lon: Column, ring: Column) -> Column:
    """0 inside."""
    return F.when(in_ring(lat, lon, ring), 0.0).otherwise(distance_to_line_m(lat, lon, ring))


def cell(value: Column, degrees: float) -> Column:
    return F.floor(value / degrees).cast("long")


def hex_cell(lat: Column, lon: Column, degrees: float) -> tuple[Column, Column]:
    """Axial (q, r) of a pointy-top hexagon grid with sides of ``degrees``; our own ids, by rounding to cube coordinates."""
    q, r = (math.sqrt(3) / 3 * lon - lat / 3) / degrees, (2 / 3 * lat) / degrees
    s = -q - r
    rq, rr, rs = F.round(q), F.round(r), F.round(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    return (F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)).cast("long"), (F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)).cast("long")


_COORDINATES = "array<array<double>>"


def geojson_type(geometry: Column) -> Column:
    return F.get_json_object(geometry, "$.type")


def geojson_vertices(geometry: Column) -> Column:
    """Vertices of a Point, LineString or Polygon (its outer ring) as array<struct<lon,lat>>; else null."""
    kind, inner = geojson_type(geometry), F.get_json_object(geometry, "$.coordinates")
    pair = F.from_json(inner, "array<double>")
    line = F.when(kind == "Point", F.array(pair)).when(kind == "LineString", F.from_json(inner, _COORDINATES)).when(kind == "Polygon", F.get(F.from_json(inner, f"array<{_COORDINATES}>"), F.lit(0)))
    return F.transform(line, lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat")))


def geojson_polygons(geometry: Column) -> Column:
    """Outer rings of a Polygon or of each part of a MultiPolygon, to explode; other shapes have none."""
    kind, inner = geojson_type(geometry), F.get_json_object(geometry, "$.coordinates")
    one, many = F.from_json(inner, f"array<{_COORDINATES}>"), F.from_json(inner, f"array<array<{_COORDINATES}>>")
    parts = F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", many)
    ring = lambda part: F.transform(F.get(part, F.lit(0)), lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat")))
    return F.transform(parts, ring)


def bounds(vertices: Column) -> Column:
    """struct<min_lon, min_lat, max_lon, max_lat>."""
    lon, lat = F.transform(vertices, lambda p: p["lon"]), F.transform(vertices, lambda p: p["lat"])
    return F.struct(F.array_min(lon).alias("min_lon"), F.array_min(lat).alias("min_lat"), F.array_max(lon).alias("max_lon"), F.array_max(lat).alias("max_lat"))


def ring_centroid(ring: Column) -> Column:
    """struct<lon, lat>: the centre of a closed ring's area; of a ring without area, the mean of its vertices.

    Worked out relative to the first vertex, so that small rings far from the origin stay exact.
    Both are null for a null ring.
    """
    o = F.get(ring, F.lit(0))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(s: Column, e: Column) -> Column:
        ax, ay, bx, by = e["a"]["lon"] - o["lon"], e["a"]["lat"] - o["lat"], e["b"]["lon"] - o["lon"], e["b"]["lat"] - o["lat"]
        turn = ax * by - bx * ay
        return F.struct((s["a"] + turn).alias("a"), (s["x"] + (ax + bx) * turn).alias("x"), (s["y"] + (ay + by) * turn).alias("y"))

    total = F.aggregate(_edges(ring), zero, add)
    n = F.size(ring)
    mean = lambda f: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[f]) / n
    return F.struct(
        F.when(total["a"] != 0, o["lon"] + total["x"] / (3 * total["a"])).otherwise(mean("lon")).alias("lon"),
        F.when(total["a"] != 0, o["lat"] + total["y"] / (3 * total["a"])).otherwise(mean("lat")).alias("lat"),
    )


def midpoint(a: Column, b: Column) -> Column:
    """struct<lon, lat> halfway between two near points (the centroid of a chord)."""
    return F.struct(((a["lon"] + b["lon"]) / 2).alias("lon"), ((a["lat"] + b["lat"]) / 2).alias("lat"))


def _cross(e: Column, f: Column) -> Column:
    """Whether two edges meet."""

    def side(p: Column, q: Column, r: Column) -> Column:
        return F.signum((q["lon"] - p["lon"]) * (r["lat"] - p["lat"]) - (q["lat"] - p["lat"]) * (r["lon"] - p["lon"]))

    return (side(e["a"], e["b"], f["a"]) != side(e["a"], e["b"], f["b"])) & (side(f["a"], f["b"], e["a"]) != side(f["a"], f["b"], e["b"]))


def lines_cross(a: Column, b: Column) -> Column:
    """Whether any edge of one line meets any edge of the other."""
    return F.exists(_edges(a), lambda e: F.exists(_edges(b), lambda f: _cross(e, f)))


def intersects_ring(vertices: Column, is_polygon: Column, ring: Column) -> Column:
    """Whether a point, line or polygon meets the area of a closed ring."""
    inside = F.exists(vertices, lambda p: in_ring(p["lat"], p["lon"], ring))
    around = is_polygon & F.exists(ring, lambda p: in_ring(p["lat"], p["lon"], vertices))
    return inside | lines_cross(vertices, ring) | around


def distance_between_lines_m(a: Column, b: Column) -> Column:
    """Metres between two lines; 0 if they cross. The least is at a vertex of one of them."""
    far = lambda p, line: distance_to_line_m(p["lat"], p["lon"], line)
    ends = F.least(F.array_min(F.transform(a, lambda p: far(p, b))), F.array_min(F.transform(b, lambda p: far(p, a))))
    return F.when(lines_cross(a, b), 0.0).otherwise(ends)
