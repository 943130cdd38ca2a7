"""Map features of an airport: tags, inventory, gates, runway corridors.

Features have id, feature_class, subtype, primary_name, names and source_tags (JSON text) and
geometry (GeoJSON text). An airport is a row (airport_code, ring), so that all can run in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airside.functions import flight as fl
from airside.functions import geo
from airside.operators.graph import components

_TAGS = "struct<key_value: array<struct<key: string, value: string>>>"
#: Classes that are airports, tags that name their codes, tags kept of a feature.
AIRPORT_CLASSES = ["international_airport", "airport", "regional_airport", "municipal_airport", "military_airport", "private_airport", "seaplane_airport"]
IATA_TAGS, ICAO_TAGS = ["iata", "iata_code", "iata:code"], ["icao", "icao_code", "icao:code"]
KEPT_TAGS = ["aeroway", "ref", "name", "width", "surface", "length", "building", "landuse"]
NUMBER_TAGS = ["width", "length"]
GATE_TAGS = ["ref", "ref:gate", "gate_ref", "name"]
DEFAULT_RADIUS_M = 30.0


def tag_list(tags: Column) -> Column:
    """The key and value pairs of a tags text; null if it doesn't parse."""
    return F.from_json(tags, _TAGS)["key_value"]


def tag_lookup(pairs: Column, *keys: str) -> Column:
    """The greatest value of the tags with any of the keys, whatever their case."""
    return F.array_max(F.transform(F.filter(pairs, lambda t: F.lower(t["key"]).isin([k.lower() for k in keys])), lambda t: fl.tidy(t["value"])))


def tag_pivot(features: DataFrame, keys: list[str]) -> DataFrame:
    """id and a column tag_<key> for each key: one row a feature, null where it lacks the tag."""
    rows = features.select("id", F.explode_outer(tag_list(F.col("source_tags"))).alias("t"))
    picked = [F.max(F.when(F.lower("t.key") == k, fl.tidy(F.col("t.value")))).alias(f"tag_{k}") for k in keys]
    return rows.groupBy("id").agg(*picked)


def airport_inventory(features: DataFrame, most: int = 5000) -> DataFrame:
    """Features that are airports and no points, with English (else primary) name and codes; by name."""
    named = F.from_json("names", f"struct<primary: string, common: {_TAGS}>")
    rows = features.where(F.col("feature_class").isin(AIRPORT_CLASSES) & F.lower("subtype").contains("airport") & (geo.geojson_type(F.col("geometry")) != "Point"))
    rows = rows.withColumn("n", named).withColumn("t", tag_list(F.col("source_tags")))
    name = F.coalesce(tag_lookup(F.col("n.common.key_value"), "en"), F.col("n.primary"))
    code = lambda keys: F.coalesce(tag_lookup(F.col("t"), *keys), F.lit(""))
    found = rows.select(F.col("id").alias("airport_id"), name.alias("airport_name"), code(IATA_TAGS).alias("airport_iata"), code(ICAO_TAGS).alias("airport_icao"))
    return found.where("airport_name IS NOT NULL").orderBy("airport_name", "airport_id").limit(most)


def airport_properties(features: DataFrame) -> DataFrame:
    """airport_id, bounds and centre of features that are areas."""
    rows = features.where(geo.geojson_type(F.col("geometry")) == "Polygon").withColumn("ring", geo.geojson_vertices(F.col("geometry")))
    placed = rows.withColumn("b", geo.bounds(F.col("ring"))).withColumn("c", geo.ring_centroid(F.col("ring")))
    return placed.select(F.col("id").alias("airport_id"), "b.min_lon", "b.min_lat", "b.max_lon", "b.max_lat", F.col("c.lon").alias("center_lon"), F.col("c.lat").alias("center_lat"))


def _meeting(features: DataFrame, ring: Column) -> DataFrame:
    """Features that meet the ring, with their vertices; the extents rule most of them out first.

    Vertices come out of a generator, so that the conditions, which mention them often, aren't
    pulled below it and the JSON isn't parsed at each mention.
    """
    placed = features.withColumn("vertices", F.explode(F.array(geo.geojson_vertices(F.col("geometry")))))
    own, area = geo.bounds(F.col("vertices")), geo.bounds(ring)
    over = (own["min_lon"] <= area["max_lon"]) & (own["max_lon"] >= area["min_lon"]) & (own["min_lat"] <= area["max_lat"]) & (own["max_lat"] >= area["min_lat"])
    return placed.where(over).where(geo.intersects_ring(F.col("vertices"), geo.geojson_type(F.col("geometry")) == "Polygon", ring))


def infrastructure(features: DataFrame, ring: Column) -> DataFrame:
    """Features that meet the airport's area, with their kept tags as columns."""
    kept = _meeting(features, ring).withColumn("t", tag_list(F.col("source_tags")))
    tags = [tag_lookup(F.col("t"), k).try_cast("double" if k in NUMBER_TAGS else "string").alias(f"tag_{k}") for k in KEPT_TAGS]
    return kept.select("id", "feature_class", "subtype", "primary_name", geo.geojson_type(F.col("geometry")).alias("geometry_type"), *tags)


def infrastructure_types(found: DataFrame) -> DataFrame:
    return found.groupBy("feature_class", "subtype").agg(F.count("*").alias("features"))


def infrastructure_layers(found: DataFrame, classes: list[str]) -> DataFrame:
    """Features of the chosen classes with a label: reference, else tagged name, else primary name."""
    label = F.coalesce(fl.tidy(F.col("tag_ref")), fl.tidy(F.col("tag_name")), fl.tidy(F.col("primary_name")))
    return found.where(F.col("feature_class").isin(classes)).select("id", "feature_class", label.alias("label"))


def gates(features: DataFrame, ring: Column, near_m: float = 2000) -> DataFrame:
    """Gate points within ``near_m`` of the airport, with the first name that any source has, else the id."""
    rows = features.where(F.lower("feature_class").contains("airport_gate")).withColumn("p", F.get(geo.geojson_vertices(F.col("geometry")), F.lit(0)))
    near = rows.where(geo.distance_to_polygon_m(F.col("p.lat"), F.col("p.lon"), ring) <= near_m).withColumn("t", tag_list(F.col("source_tags")))
    name = F.coalesce(fl.tidy(F.col("primary_name")), *[tag_lookup(F.col("t"), k) for k in GATE_TAGS], F.col("id").cast("string"))
    return near.select(F.col("id").alias("gate_id"), name.alias("gate_name"), F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"))


def runways(features: DataFrame, ring: Column) -> DataFrame:
    """id, line, radius of runway features that meet the airport: half their width, else a default."""
    is_runway = (F.lower("subtype") == "runway") | (F.lower("feature_class") == "runway") | F.coalesce(F.lower("source_tags").contains("runway"), F.lit(False))
    width = tag_lookup(tag_list(F.col("source_tags")), "width").try_cast("double")
    return _meeting(features.where(is_runway), ring).select("id", F.col("vertices").alias("line"), F.coalesce(width / 2, F.lit(DEFAULT_RADIUS_M)).alias("radius"))


def runway_corridors(found: DataFrame) -> DataFrame:
    """airport_code, runway_id, id, line, radius: corridors that overlap share a runway_id (RWY_001 on).

    ``found`` has airport_code, id, line, radius. A corridor is what lies within the radius of
    its line, so two overlap if their lines are no further apart than both radii.
    """
    box = geo.bounds(F.col("line"))
    boxed = found.withColumn("box", box)
    x, y = boxed.alias("x"), boxed.alias("y")
    reach = (F.col("x.radius") + F.col("y.radius")) / geo.DEGREE_M
    near = (F.col("x.box.min_lat") - reach <= F.col("y.box.max_lat")) & (F.col("y.box.min_lat") - reach <= F.col("x.box.max_lat"))
    met = x.join(y, (F.col("x.airport_code") == F.col("y.airport_code")) & (F.col("x.id") <= F.col("y.id")) & near)
    apart = F.when(F.col("x.id") == F.col("y.id"), 0.0).otherwise(geo.distance_between_lines_m(F.col("x.line"), F.col("y.line")))
    pairs = met.where(apart <= F.col("x.radius") + F.col("y.radius")).select("x.airport_code", F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    parts = components(pairs, ["airport_code"])
    number = F.dense_rank().over(Window.partitionBy("airport_code").orderBy("part"))
    named = parts.withColumn("runway_id", F.concat(F.lit("RWY_"), F.lpad(number.cast("string"), 3, "0"))).drop("part")
    return found.join(named, ["airport_code", "id"]).select("airport_code", "runway_id", "id", "line", "radius")
