"""Oracles at the smallest size, micro cases and properties of the airport operators."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from airside import queries as q
from airside.functions import flight as fl
from airside.functions import geo
from airside.functions.time import boundaries
from airside.operators import keyed
from airside.plans import fixtures as fx
from airside.sources import files
from airside.streaming import jobs

SF = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return round(v, 5)
    return str(v) if hasattr(v, "isoformat") or type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module", autouse=True)
def shared_tables():
    """Tables that many queries start from are made once for all tests of this module."""
    from airside import queries_airport, queries_flights, queries_reports
    from airside.sources.files import stored

    patch, made = pytest.MonkeyPatch(), {}

    def once(name, build):
        def get(s, d):
            if (name, d) not in made:
                found = build(s, d)
                made[name, d] = found if isinstance(found, tuple) else stored(found, name)
            return made[name, d]

        return get

    for name, home, users in (
        ("matched", q, [q]),
        ("enriched", queries_airport, [queries_airport, queries_reports]),
        ("local", queries_airport, [queries_airport, queries_flights, queries_reports]),
        ("events", queries_flights, [queries_flights, queries_reports]),
        ("_at_gates", q, [q]),
    ):
        get = once(name, getattr(home, name))
        for module in users:
            patch.setattr(module, name, get)
    yield
    patch.undo()


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = q.QUERIES[name](spark, SF)
    want = con.sql(q.ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a = sorted((tuple(_plain(r[c]) for c in cols) for r in got.collect()), key=repr)
    b = sorted((tuple(_plain(v[want.columns.index(c)]) for c in cols) for v in want.fetchall()), key=repr)
    assert a == b


def test_minutes_are_boundaries(spark):
    r = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:59' a, timestamp_ntz'2024-01-01 00:01:00' b").select(boundaries("minute", F.col("a"), F.col("b"))).first()
    assert r[0] == 1


def test_polygon_distance(spark):
    rows = [(32.0, -117.0, True), (32.02, -117.0, False), (32.0, -117.03, False)]
    df = spark.createDataFrame(rows, "lat double, lon double, inside boolean")
    for r in df.select("inside", geo.in_ring(F.col("lat"), F.col("lon"), fx.ring()).alias("got"), geo.distance_to_polygon_m(F.col("lat"), F.col("lon"), fx.ring()).alias("m")).collect():
        assert r["inside"] == r["got"] and (r["m"] == 0) == r["inside"]


def test_callsigns(spark):
    df = spark.createDataFrame([("aal123W",), ("DL45",), ("X",), (None,)], "c string")
    got = df.select(fl.callsign_base(F.col("c")), fl.callsign_prefix(F.col("c")), fl.callsign_number(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [("AAL123", "AAL", "123"), ("DL45", "DL", "45"), ("", None, None), (None, None, None)]


def test_upsert_twice_changes_nothing(spark):
    t = spark.createDataFrame([(1, None), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(1, "a"), (3, "c"), (2, "z")], "k int, v string")
    once = keyed.upsert_newest(t, b, ["k"], [F.col("v").desc()], ["v"])
    twice = keyed.upsert_newest(once, b, ["k"], [F.col("v").desc()], ["v"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a"), (2, "b"), (3, "c")]


def test_trace_files(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"icao":"abc","timestamp":1704067200,"trace":[[0.5,32.0,-117.0,"ground",3.0,null,0,0,null],[10,32.1,-117.0,1500,200.0,null,0,0,{"flight":"AAL1 "}]]}\nnot json\n')
    got = files.flatten_trace(files.load_trace_ndjson(spark, str(tmp_path))).orderBy("n").collect()
    assert [(r["altitude_baro"], r["flight"], str(r["ts"])) for r in got] == [(0, "AAL1", "2024-01-01 00:00:00.500000"), (1500, "AAL1", "2024-01-01 00:00:10")]


def test_arrays_and_csv(spark, tmp_path):
    df = spark.createDataFrame([(["d1", "d2"], ["1"])], "date array<string>, pax array<string>")
    assert [tuple(r) for r in files.tsa_parallel_arrays_flatten(df, ["date", "pax"]).collect()] == [("d1", "1"), ("d2", "")]
    (tmp_path / "a.csv").write_text("id,name,iata,icao,callsign,country,active\n1,One,AA,AAA,-,US,Y\nx,Two,\\N,BBB,N/A,,N\n")
    got = files.read_airline_csv(spark, str(tmp_path)).orderBy("airline_name").collect()
    assert [(r["airline_id"], r["airline_iata"], r["airline_callsign"]) for r in got] == [(1, "AA", None), (None, None, None)]
    assert files.airline_code_map(files.read_airline_csv(spark, str(tmp_path))).count() == 1


def test_stream_sessions_match_one_batch(spark, tmp_path):
    rows = "SELECT 'A' AS icao_hex, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, m) AS ts FROM VALUES (0), (20), (41), (60) AS t(m)"
    spark.sql(rows).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("icao_hex string, ts timestamp").parquet(str(tmp_path / "in"))
    run = jobs.stream_sessions(stream, "UTC").writeStream.format("memory").queryName("sessions_out").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r["points"] for r in spark.table("sessions_out").collect()) == [2, 2]


def test_stream_sessions_end_with_the_local_day(spark, tmp_path):
    """Eight hours behind UTC the day ends at 08:00: one stay of 40 minutes becomes two."""
    rows = "SELECT 'A' AS icao_hex, timestamp'2024-01-01 07:40:00' + make_interval(0, 0, 0, 0, 0, m) AS ts FROM VALUES (0), (15), (25), (40) AS t(m)"
    spark.sql(rows).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("icao_hex string, ts timestamp").parquet(str(tmp_path / "in"))
    run = jobs.stream_sessions(stream, fx.TZ).writeStream.format("memory").queryName("days_out").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted((str(r["service_date"]), r["points"]) for r in spark.table("days_out").collect()) == [("2023-12-31", 2), ("2024-01-01", 2)]


def test_repeated_hour(spark):
    """On 2024-11-03 both 08:30 and 09:30 UTC are 01:30 in the airport's zone, on one day."""
    from airside.functions.time import local_ts, service_date

    df = spark.sql("SELECT timestamp_ntz'2024-11-03 08:30:00' t UNION ALL SELECT timestamp_ntz'2024-11-03 09:30:00'")
    got = df.select(local_ts(F.col("t"), fx.TZ).alias("l"), service_date(F.col("t"), fx.TZ).alias("d")).distinct().collect()
    assert [(str(r["l"]), str(r["d"])) for r in got] == [("2024-11-03 01:30:00", "2024-11-03")]


def _metres_apart(a, b):
    """Brute force: the least distance of points along two lines."""
    from math import cos, hypot, radians

    def along(line, n=400):
        (x0, y0), (x1, y1) = line
        return [(x0 + (x1 - x0) * i / n, y0 + (y1 - y0) * i / n) for i in range(n + 1)]

    return min(hypot((p[0] - q[0]) * cos(radians(p[1])), p[1] - q[1]) * geo.DEGREE_M for p in along(a) for q in along(b))


def test_runway_corridors_against_brute_force(spark):
    import random

    from airside.operators import infrastructure as infra

    rng, sure = random.Random(3), False
    while not sure:  # no pair so near the limit that the steps of the brute force decide
        lines = {i: ((-117 + rng.randrange(400) * 1e-4, 32 + rng.randrange(400) * 1e-4), (-117 + rng.randrange(400) * 1e-4, 32 + rng.randrange(400) * 1e-4)) for i in range(11)}
        radius = {i: rng.choice([30.0, 120.0, 300.0]) for i in lines}
        apart = {(i, j): _metres_apart(lines[i], lines[j]) for i in lines for j in range(i)}
        sure = all(abs(m - radius[i] - radius[j]) > 12 for (i, j), m in apart.items())
    rows = [(code, i, [{"lon": x, "lat": y} for x, y in line], radius[i]) for code in ("AAA", "BBB") for i, line in lines.items() if code == "AAA" or i % 2]
    df = spark.createDataFrame(rows, "airport_code string, id long, line array<struct<lon:double,lat:double>>, radius double")
    got = {(r["airport_code"], r["id"]): r["runway_id"] for r in infra.runway_corridors(df).collect()}
    for code in ("AAA", "BBB"):
        ids = [i for i in lines if code == "AAA" or i % 2]
        part = {i: i for i in ids}
        for i in ids:
            for j in ids:
                if i > j and apart[i, j] <= radius[i] + radius[j]:
                    old, new = part[i], part[j]
                    part = {k: min(old, new) if v in (old, new) else v for k, v in part.items()}
        number = {p: f"RWY_{n + 1:03d}" for n, p in enumerate(sorted(set(part.values())))}
        assert {i: got[(code, i)] for i in ids} == {i: number[part[i]] for i in ids}


def test_places_near_the_pole_and_by_shuffle(spark, monkeypatch):
    """All pairs within the radius at any latitude, whether places are broadcast or shuffled."""
    import random
    from math import asin, cos, radians, sin, sqrt

    from airside.operators import spatial

    rng = random.Random(4)
    places = [(i, lat + rng.random() * 0.02, 20 + rng.random() * 0.05) for i, lat in enumerate([69.6] * 20 + [-82.0] * 20 + [0.0] * 20)]
    points = [(i, p[1] + (rng.random() - 0.5) * 0.01, p[2] + (rng.random() - 0.5) * 0.03) for i, p in enumerate(places * 3)]

    def metres(a, b):
        h = sin(radians(b[1] - a[1]) / 2) ** 2 + cos(radians(a[1])) * cos(radians(b[1])) * sin(radians(b[2] - a[2]) / 2) ** 2
        return 2 * geo.EARTH_M * asin(sqrt(min(1, h)))

    want = {(p[0], g[0]) for p in points for g in places if metres(p, g) <= 500}
    best = {p[0]: min(((metres(p, g), g[0]) for g in places if metres(p, g) <= 500), default=(None, None))[1] for p in points}
    p, g = spark.createDataFrame(points, "event_id long, lat double, lon double"), spark.createDataFrame(places, "gate_id long, lat double, lon double")
    for most in (100, 0):
        monkeypatch.setattr(spatial, "BROADCAST_PLACES", most)
        assert {(r["event_id"], r["gate_id"]) for r in spatial.places_within(p, g, 500).collect()} == want and len(want) > 50
        assert {r["event_id"]: r["gate_id"] for r in spatial.nearest_place(p, "event_id", g, 500).collect()} == best


def test_shapes(spark):
    """Centre of a triangle, features around the airport or through it, parts of a multipolygon, odd texts."""
    tri = '{"type":"Polygon","coordinates":[[[0,0],[3,0],[0,3],[0,0]]]}'
    around = '{"type":"Polygon","coordinates":[[[-118,31],[-116,31],[-116,33],[-118,33],[-118,31]]]}'
    through = '{"type":"LineString","coordinates":[[-118,32.001],[-116,32.002]]}'
    beside = '{"type":"LineString","coordinates":[[-118,32.1],[-116,32.1]]}'
    many = '{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}'
    df = spark.createDataFrame([("tri", tri), ("around", around), ("through", through), ("beside", beside), ("many", many), ("odd", "no json"), ("none", None)], "k string, g string")
    v = geo.geojson_vertices(F.col("g"))
    rows = {r["k"]: r for r in df.select("k", geo.ring_centroid(v).alias("c"), geo.intersects_ring(v, geo.geojson_type(F.col("g")) == "Polygon", fx.ring()).alias("meets"), F.size(geo.geojson_polygons(F.col("g"))).alias("parts")).collect()}
    assert (round(rows["tri"]["c"]["lon"], 9), round(rows["tri"]["c"]["lat"], 9)) == (1, 1)
    assert {k: rows[k]["meets"] for k in ("tri", "around", "through", "beside")} == {"tri": False, "around": True, "through": True, "beside": False}
    assert rows["many"]["parts"] == 2 and rows["tri"]["parts"] == 1 and rows["odd"]["meets"] is None and rows["none"]["c"]["lon"] is None


def test_crossing_of_one_point_and_at_the_ends(spark):
    """A stay of one point, one that begins with the flight, one that ends with it."""
    from airside.operators import spatial

    inside, outside = (32.0, -117.0), (32.05, -117.0)
    path = [inside, outside, inside, outside, inside, (32.0005, -117.0)]
    rows = [(i, "k", f"2024-01-01 00:0{i}:00", lat, lon, None if i == 2 else 10.0 * i) for i, (lat, lon) in enumerate(path)]
    points = spark.createDataFrame(rows, "event_id long, flight_key string, t string, lat double, lon double, velocity double").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    got = spatial.runway_crossings(points, fx.runways(spark).where("runway_id = 'RWY_001'")).orderBy("event").collect()
    assert [(r["event"], r["seconds"], r["max_speed"], r["direction"]) for r in got] == [(1, 0, 0.0, "uncertain"), (2, 0, 0.0, "uncertain"), (3, 60, 50.0, "S→N")]


def test_schedule_times_and_codes(spark):
    """Offsets and airport-local times in a session of another zone; a payload that is no JSON."""
    from airside.operators import schedules

    value = '{"data":[{"flight":{"number":"12","iata":null},"airline":{"iata":" aa ","icao":"AAL"},"departure":{"iata":"TST","scheduled":"2024-07-01T10:00:00+02:00","actual":"2024-07-01T01:30:00"},"arrival":{"iata":"OTH","scheduled":"bad"}}]}'
    df = spark.createDataFrame([("2024-07-01", value), ("2024-07-01", "{oops"), ("2024-07-01", None)], "d string, value string").selectExpr("CAST(d AS DATE) AS flight_date", "value", "timestamp_ntz'2024-07-01 00:00:00' AS ingested_at")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        got = schedules.schedule_parse(df, fx.TZ).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [(r["flight_iata"], r["flight_icao"], str(r["dep_scheduled"]), str(r["dep_actual"]), r["arr_scheduled"]) for r in got] == [("AA12", "AAL12", "2024-07-01 08:00:00", "2024-07-01 08:30:00", None)]


def test_schedule_upsert_twice_changes_nothing(spark):
    from airside.operators import schedules

    cols = "flight_key string, flight_status string, dep_actual string, flight_number string, is_codeshare boolean, updated_at string"
    target = spark.createDataFrame([], cols)
    rows = [("AA1", "2024-01-01 10:00:00", "x", "1", "2024-01-01"), ("AA1", "2024-01-01 10:00:00", "y", "9", "2024-01-02"), (None, None, "z", "2", "2024-01-01")]
    batch = spark.createDataFrame(rows, "flight_iata string, dep string, flight_status string, flight_number string, updated_at string").selectExpr("*", "CAST(dep AS TIMESTAMP_NTZ) AS dep_scheduled", "CAST(NULL AS TIMESTAMP_NTZ) AS arr_scheduled", "CAST(NULL AS STRING) AS codeshare_airline", "'now' AS dep_actual")
    once = schedules.schedule_etl_upsert(target, batch)
    twice = schedules.schedule_etl_upsert(once, batch)
    assert sorted(map(tuple, once.collect()), key=repr) == sorted(map(tuple, twice.collect()), key=repr)
    assert sorted(r["flight_status"] for r in once.collect()) == ["y", "z"]


def test_meta_merge(spark):
    """Null keys meet; of several rows of one key the newest counts, whole, so that no row is made of two."""
    t = spark.createDataFrame([("a", 1, None), (None, 2, "x")], "k string, v int, w string")
    b = spark.createDataFrame([("a", None, "n"), ("a", 7, None), (None, None, "y"), ("c", 3, None)], "k string, v int, w string")
    assert sorted(map(tuple, keyed.merge_coalesce(t, b, "k", ["v"]).collect()), key=repr) == sorted([("a", 7, None), (None, 2, "y"), ("c", 3, None)], key=repr)
    assert sorted(map(tuple, keyed.merge_coalesce(t, b, "k", ["w"]).collect()), key=repr) == sorted([("a", 1, "n"), (None, 2, "y"), ("c", 3, None)], key=repr)


def test_latest_file_and_bad_names(spark):
    f = spark.createDataFrame([("a/report_01-02-2024_to_01-08-2024.pdf",), ("a/report_12-30-2023.pdf",), ("a/notes.pdf",)], "path string")
    none = f.limit(0)
    assert [r["path"] for r in files.latest_file_pick(f, none).collect()] == ["a/report_01-02-2024_to_01-08-2024.pdf"]
    assert files.latest_file_pick(f, f.limit(1)).count() == 0 and files.latest_file_pick(none, none).count() == 0


def test_empty_choice_selects_nothing(spark):
    df = spark.createDataFrame([("HELICOPTER",), (None,)], "label string")
    assert df.where(fl.vehicle_filter(F.col("label"), [])).count() == 0
    assert df.where(fl.vehicle_filter(F.col("label"), ["HELICOPTER"])).count() == 1


def test_translated_codes(spark):
    """A schedule that knows an airline by its IATA code only, a callsign with the ICAO code."""
    from airside.operators import matching

    legs = spark.sql("SELECT 'h' AS icao_hex, DATE'2024-01-01' AS service_date, 1L AS segment, timestamp_ntz'2024-01-01 10:00:00' AS start_ts, timestamp_ntz'2024-01-01 11:00:00' AS end_ts, CAST(NULL AS STRING) AS registration, 'AAL12' AS callsign, 'departure' AS direction")
    flights = spark.sql("SELECT 1L AS schedule_key, DATE'2024-01-01' AS flight_date, CAST(NULL AS STRING) AS flight_icao, CAST(NULL AS STRING) AS flight_iata, CAST(NULL AS STRING) AS airline_icao, 'AA' AS airline_iata, '12' AS flight_number, CAST(NULL AS STRING) AS sched_registration, timestamp_ntz'2024-01-01 09:55:00' AS dep_scheduled, timestamp_ntz'2024-01-01 11:00:00' AS arr_scheduled")
    assert matching.match_candidates(legs, flights).count() == 0
    codes = spark.createDataFrame([("AA", "AAL"), ("DL", "DAL")], "airline_iata string, airline_icao string")
    assert [r["gap"] for r in matching.match_candidates(legs, flights, codes).collect()] == [5]
