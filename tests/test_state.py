"""Versioned tables, stateful legs, late rows, incremental refresh and cell covers: properties and micro cases."""

import math
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from airside import queries_state as qs
from airside.functions import geo
from airside.operators import cover as cv
from airside.operators import spatial
from airside.plans import fixtures as fx
from airside.plans.cascade import SILVER, STEPS, Cascade
from airside.sources import files
from airside.sources.versions import Conflict, VersionedTable
from airside.streaming import jobs

SF = "/root/testdata/sf0.001"
ROWS = "id long, value string, service_date date"


def rows(spark, *found):
    return spark.createDataFrame([(i, v, datetime.fromisoformat(d).date()) for i, v, d in found], ROWS)


def content(df):
    return sorted((r["id"], r["value"], str(r["service_date"])) for r in df.collect())


def newest(known, new):
    return new.unionByName(known.join(new.select("id"), "id", "left_anti"))


def test_merge_touches_its_days_only(spark):
    table = VersionedTable(spark, files.scratch(spark, "v"), ROWS)
    assert content(table.read()) == [] and table.folders() == {}
    assert table.merge(rows(spark, (1, "a", "2024-01-01"), (2, "b", "2024-01-02")), newest, "w", 1)
    before = table.folders()
    assert table.merge(rows(spark, (2, "c", "2024-01-02"), (3, "d", "2024-01-03")), newest, "w", 2)
    after = table.folders()
    assert after["2024-01-01"] == before["2024-01-01"] and after["2024-01-02"] != before["2024-01-02"] and len(after) == 3
    assert content(table.read()) == [(1, "a", "2024-01-01"), (2, "c", "2024-01-02"), (3, "d", "2024-01-03")]
    assert content(table.read(version=1)) == [(1, "a", "2024-01-01"), (2, "b", "2024-01-02")]
    assert content(table.read(days=["2024-01-03"])) == [(3, "d", "2024-01-03")]
    # A batch that comes again, or an older one, changes nothing; another writer's number is its own.
    assert not table.merge(rows(spark, (2, "x", "2024-01-02")), newest, "w", 2) and not table.merge(rows(spark, (2, "x", "2024-01-02")), newest, "w", 1)
    assert table.folders() == after
    assert table.merge(rows(spark, (9, "e", "2024-01-03")), lambda known, new: new.limit(0), "other", 1)
    assert sorted(table.folders()) == ["2024-01-01", "2024-01-02"]  # a day without rows goes
    reopened = VersionedTable.existing(spark, table.root)
    assert reopened.schema == table.schema and content(reopened.read()) == content(table.read())
    assert VersionedTable.existing(spark, files.scratch(spark, "none")) is None


def test_versions_appear_whole_and_once(spark):
    table = VersionedTable(spark, files.scratch(spark, "v"), ROWS)
    table.merge(rows(spark, (1, "a", "2024-01-01")), newest)
    found = table.manifest()
    table.merge(rows(spark, (2, "b", "2024-01-01")), newest)
    with pytest.raises(Conflict):  # made from a version that is no longer the last
        table.publish(found, {"2024-01-01": None})
    assert content(table.read()) == [(1, "a", "2024-01-01"), (2, "b", "2024-01-01")]
    stream = table._fs.create(table._path(f"{table.root}/manifests/{3:012d}.json"), False)
    stream.write(bytearray(b'{"version": 3, "da'))  # a writer died here
    stream.close()
    assert table.manifest().version == 2
    table.merge(rows(spark, (4, "d", "2024-01-02")), newest)
    assert table.manifest().version == 4 and len(content(table.read())) == 3
    with pytest.raises(ValueError, match="doesn't touch"):
        table.merge(rows(spark, (5, "e", "2024-01-05")), lambda known, new: new.withColumn("service_date", F.lit("2024-01-06").cast("date")))
    table.merge(spark.createDataFrame([], ROWS), newest, "w", 7)
    assert table.manifest().batches == {"w": 7} and len(content(table.read())) == 3
    table.merge(spark.createDataFrame([(6, "f", None)], ROWS), newest)  # a row without a day has no place
    assert len(content(table.read())) == 3


# --- legs ----------------------------------------------------------------------------------------


def plain_segments(points):
    """One point at a time."""
    done, now, number, day_before = [], None, 0, None
    for us, day, ground in points:
        if now is None or day != now[0] or us // 60_000_000 - now[4] // 60_000_000 > 20 or ground != now[2]:
            if now:
                done.append(tuple(now))
            number = 1 if day != day_before else number + 1
            now = [day, number, ground, us, us, 0]
        now[4], now[5], day_before = us, now[5] + 1, day
    return done, now


@pytest.mark.parametrize("seed", range(40))
def test_segments_in_parts_are_those_of_the_whole(seed):
    r = random.Random(seed)
    us, points = 0, []
    for _ in range(r.randint(1, 60)):
        us += r.choice([0, 1, 60_000_000, 600_000_000, 1_200_000_000, 1_260_000_000, 5_000_000_000])
        points.append((us, us // 20_000_000_000, r.random() < 0.4))
    want, last = plain_segments(points)
    got, state, at = [], None, 0
    while at < len(points):
        part = points[at : (at := at + r.randint(1, 9))]
        done, state = jobs.next_segments(pd.DataFrame(part, columns=["us", "day", "ground"]), state)
        got += done
    assert got == want and list(state[:6]) == last


def test_legs_of_shuffled_micro_batches(spark):
    """Points of one aircraft in any order within the watermark; a late one is left out; a leg ends by the gap alone."""
    start = datetime(2024, 1, 1, 10)
    minutes = [0, 5, 11, 13, 40, 45, 47, 60]
    at = lambda m: start + timedelta(minutes=m)
    kind = "event_id long, icao_hex string, ts timestamp, velocity double, altitude_baro int"
    row = lambda i, m: (i, "A", at(m), 200.0 if m != 13 else 10.0, 5000 if m != 13 else 0)
    order = [[(2, 11), (1, 5)], [(0, 0), (4, 40), (3, 13)], [(6, 47), (5, 45), (7, 60)]]
    parts = [spark.createDataFrame([row(i, m) for i, m in p], kind) for p in order]
    late = spark.createDataFrame([row(8, 1), row(9, 600)], kind)
    legs = qs._run(spark, jobs.stream_legs(qs.landings(spark, [*parts, late]), "UTC", "30 minutes")).where("icao_hex = 'A'").orderBy("segment").collect()
    assert [(r["segment"], r["start_ts"], r["end_ts"], r["points"]) for r in legs] == [(1, at(0), at(11), 3), (3, at(40), at(60), 4), (4, at(600), at(600), 1)]
    assert len(minutes) == 8


def test_late_rows_come_once(spark):
    """The watermark is that of the batches before; a replayed batch adds to neither table; days are worked through again."""
    kind = "event_id long, ts timestamp, service_date date"
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    part = lambda *hours: spark.createDataFrame([(h, at(h), at(h).date()) for h in hours], kind)
    table, side = VersionedTable(spark, files.scratch(spark, "t"), kind), VersionedTable(spark, files.scratch(spark, "s"), kind)
    stream, seen = qs.landings(spark, [part(10, 30), part(27, 28, 29), part(9, 31)], end=False), []
    jobs.stream_late(stream, table, side, files.scratch(spark, "c"), "2 hours", seen.append).awaitTermination()
    assert sorted(r["event_id"] for r in side.read().collect()) == [9, 27, 28]
    assert sorted(r["event_id"] for r in table.read().collect()) == [9, 10, 27, 28, 29, 30, 31]
    assert seen == [["2024-01-02"], ["2024-01-01"]]
    again = jobs.stream_late(stream, table, side, files.scratch(spark, "c"), "2 hours")  # a lost checkpoint: all batches come again
    again.awaitTermination()
    assert side.read().count() == 3 and table.read().count() == 7


# --- derived tables ------------------------------------------------------------------------------


def test_refresh_after_a_late_batch(spark):
    """Only the late batch's day is made anew where no other depends on it, and all tables are those of a full refresh."""
    cascade, (first, second) = qs.late_cascade(spark, SF)
    assert set(first) == set(STEPS) and len(set(STEPS) - set(SILVER)) == 13
    assert second["legs"] == second["ground_points"] == second["traffic_daily"] == ["2024-01-01"]
    for name in ("legs", "ground_sessions", "ground_points", "flight_gate_time", "gate_util_daily", "traffic_daily", "airline_traffic_daily", "runway_crossings"):
        assert second[name] in (["2024-01-01"], []), name  # what comes out as it was is kept
        kept = cascade.tables[name].folders(version=cascade.tables[name].versions()[-2])
        assert {d: f for d, f in cascade.tables[name].folders().items() if d != "2024-01-01"} == {d: f for d, f in kept.items() if d != "2024-01-01"}
    assert not any(cascade.refresh().values())  # nothing has changed
    reopened = Cascade(spark, cascade.root, qs.airport(spark, SF))
    for name in ("points", "schedule"):
        reopened.tables[name] = cascade.tables[name]
    assert not any(reopened.refresh().values())  # nor for another session
    whole = Cascade(spark, files.scratch(spark, "whole"), qs.airport(spark, SF))
    for name, day in (("points", "service_date"), ("schedule", "flight_date")):
        held = cascade.tables[name].read()
        whole.source(name, held, day).merge(held, lambda known, new: new)
    whole.refresh()
    for name in STEPS:
        a, b = (c.tables[name].read() for c in (cascade, whole))
        assert a.count() == b.count() and a.exceptAll(b).isEmpty(), name


# --- covers --------------------------------------------------------------------------------------


@pytest.mark.parametrize("lat", [0.0, 32.0, -54.8, 69.7, 84.0])
@pytest.mark.parametrize("area", [True, False])
def test_cover_is_the_exact_distance(spark, lat, area):
    """Rings and corridors at several latitudes, with points close to their edges above all."""
    r = random.Random(int(lat))
    shrink = max(0.05, math.cos(math.radians(lat)))
    corner = lambda: {"lon": 20 + r.uniform(-0.02, 0.02) / shrink, "lat": lat + r.uniform(-0.02, 0.02)}
    shape = [corner() for _ in range(5)]
    shape = [*shape, shape[0]] if area else shape
    reach, cell = (5000.0, 625.0) if area else (150.0, 100.0)
    spread = 0.09 if area else 0.03
    points = spark.createDataFrame([(i, lat + r.uniform(-spread, spread), 20 + r.uniform(-spread, spread) / shrink) for i in range(3000)] + [(9999, None, None)], "id long, lat double, lon double")
    cells = cv.cover(spark.createDataFrame([(1, shape)], "shape_id int, line array<struct<lon:double,lat:double>>"), "line", F.lit(reach), cell, area)
    away = (geo.distance_to_polygon_m if area else geo.distance_to_line_m)(F.col("lat"), F.col("lon"), F.array(*[F.struct(F.lit(p["lon"]).alias("lon"), F.lit(p["lat"]).alias("lat")) for p in shape]))
    got = cv.flag_within(points, cells, "line", cell, area, "near").withColumn("want", F.coalesce(away <= reach, F.lit(False)))
    assert got.count() == 3001 and got.where("near <> want").isEmpty()
    assert 0.01 < got.where("near").count() / 3000 < 0.95
    assert sorted(i["id"] for i in cv.within(points, cells, "line", cell, area).collect()) == sorted(i["id"] for i in got.where("want").collect())
    assert cells.where("full").count() > 0 or not area


def test_corridors_meet_points_without_a_nested_loop(spark):
    keyed = fx.points(spark, SF).withColumn("flight_key", F.col("icao_hex"))
    plan = spatial.runway_crossings(keyed, fx.runways(spark))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_cover_of_several_shapes_and_of_none(spark):
    lines = [("a", [{"lon": 0.0, "lat": 0.0}, {"lon": 0.01, "lat": 0.0}]), ("b", [{"lon": 0.005, "lat": -0.005}, {"lon": 0.005, "lat": 0.005}]), ("none", None), ("point", [{"lon": 0.0, "lat": 0.0}])]
    cells = cv.cover(spark.createDataFrame(lines, "k string, line array<struct<lon:double,lat:double>>"), "line", F.lit(60.0), 100.0, False)
    points = spark.createDataFrame([(1, 0.0, 0.005), (2, 0.0, 0.0), (3, 0.004, 0.005), (4, 0.01, 0.01)], "id long, lat double, lon double")
    assert sorted((r["id"], r["k"]) for r in cv.within(points, cells, "line", 100.0, False).collect()) == [(1, "a"), (1, "b"), (2, "a"), (3, "b")]
    assert cv.within(points, cells.limit(0), "line", 100.0, False).isEmpty()
