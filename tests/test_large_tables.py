"""Operators whose work or result once went wrong on larger or odd tables: ties, crowded callsigns, crowded gates."""

import random

import pytest
from pyspark.sql import functions as F

from airside.operators import matching, schedules
from airside.plans import fixtures as fx


def _payloads(spark, names):
    """Two flights that differ in their codeshare partner only, in this order."""
    flight = '{{"flight":{{"number":"12","iata":"AA12","icao":"AAL12","codeshared":{{"airline_name":"{0}"}}}},"airline":{{"iata":"AA","icao":"AAL"}},"departure":{{"iata":"TST","scheduled":"2024-07-01T10:00:00"}},"arrival":{{"iata":"OTH"}}}}'
    value = '{"data":[' + ",".join(flight.format(n) for n in names) + "]}"
    return spark.createDataFrame([(value,)], "value string").selectExpr("DATE'2024-07-01' AS flight_date", "value", "timestamp_ntz'2024-07-01 00:00:00' AS ingested_at")


def test_flights_alike_in_all_that_orders_them(spark):
    """Which of them counts doesn't hang on their order."""
    got = [[r["codeshare_airline"] for r in schedules.schedule_parse(_payloads(spark, names), fx.TZ).collect()] for names in (("One", "Two"), ("Two", "One"))]
    assert got == [["One"], ["One"]]


def test_upsert_of_rows_alike_in_all_that_orders_them(spark):
    target = spark.createDataFrame([], "flight_key string, flight_status string, flight_number string, updated_at string")
    found = []
    for states in (("landed", "active"), ("active", "landed")):
        rows = spark.createDataFrame([("AA1", x, "1", "2024-01-01") for x in states], "flight_iata string, flight_status string, flight_number string, updated_at string").coalesce(1)
        batch = rows.selectExpr("*", "timestamp_ntz'2024-01-01 10:00:00' AS dep_scheduled", "CAST(NULL AS TIMESTAMP_NTZ) AS arr_scheduled", "CAST(NULL AS STRING) AS codeshare_airline")
        found.append([r["flight_status"] for r in schedules.schedule_etl_upsert(target, batch).collect()])
    assert found == [["active"], ["active"]]


def _crowd(spark, n):
    """``n`` legs and schedule rows of a few callsigns, airports and minutes, with nulls; some aircraft have a registration."""
    rng = random.Random(5)
    pick = lambda *values: rng.choice(values)
    at = lambda: f"2024-01-0{rng.randrange(1, 4)} {rng.randrange(6, 9):02d}:{rng.randrange(60):02d}:{rng.randrange(60):02d}"
    legs = [(f"A{i}", f"2024-01-0{rng.randrange(1, 4)}", 1, at(), at(), pick(None, f"N{i % 40}"), pick("AAL1", "AAL1W", "AA2", " aal2", "X", None), pick("departure", "arrival", "local", "unknown")) for i in range(n)]
    rows = [(pick(i, i // 2), f"2024-01-0{rng.randrange(1, 5)}", pick("AAL1", None), pick("AA1", "AA2", None), pick("AAL", None), "AA", pick("1", "2"), pick(None, f"N{i % 40}"), pick("TST", "OTH", None), pick("TST", "OTH", None), pick(at(), None), pick(at(), None)) for i in range(n)]
    one = spark.createDataFrame(legs, "icao_hex string, d string, segment long, a string, z string, registration string, callsign string, direction string")
    two = spark.createDataFrame(rows, "schedule_key long, d string, flight_icao string, flight_iata string, airline_icao string, airline_iata string, flight_number string, sched_registration string, dep_airport string, arr_airport string, a string, z string")
    times = lambda df, day, a, z: df.withColumns({day: F.col("d").cast("date"), a: F.col("a").cast("timestamp_ntz"), z: F.col("z").cast("timestamp_ntz")}).drop("d", "a", "z")
    return times(one, "service_date", "start_ts", "end_ts"), times(two, "flight_date", "dep_scheduled", "arr_scheduled")


@pytest.mark.parametrize("mapped", [False, True])
def test_best_matches_are_those_of_all_pairs(spark, mapped):
    """Written out from the pairs, by the rule's order: registration, direction (unknown first), score, gap, days, key."""
    legs, rows = _crowd(spark, 300)
    codes = spark.createDataFrame([("AA", "AAL")], "airline_iata string, airline_icao string") if mapped else None
    scored = matching.match_score(matching.match_candidates(legs, rows, codes), ["TST"]).collect()
    want = {}
    for r in scored:
        place = (r["method"] != "registration_time", {None: 0, True: 1, False: 2}[r["direction_ok"]], -r["score"], abs(r["gap"]), r["day_diff"], r["schedule_key"])
        leg = (r["icao_hex"], r["service_date"], r["segment"])
        want[leg] = min(want.get(leg, (place, r["method"])), (place, r["method"]))
    got = matching.best_matches(legs, rows, ["TST"], codes).collect()
    assert len(scored) > 2000 and len(got) == len(want) > 150
    for r in got:
        (_, _, less, gap, days, key), method = want[r["icao_hex"], r["service_date"], r["segment"]]
        assert (r["schedule_key"], r["method"], r["score"], r["confidence"], r["time_gap"], r["day_diff"]) == (key, method, -less, max(0, -less), gap, days)


def _joined_rows(df):
    """Rows that come out of the joins of the plan as it was run."""
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        children = node.children()
        todo.extend(children.apply(i) for i in range(children.size()))
        if "Join" in name and node.metrics().contains("numOutputRows"):
            total += node.metrics().apply("numOutputRows").value()
    return total


def test_work_of_best_matches_follows_the_rows(spark):
    """One callsign: four times the legs and flights make 16 times the pairs; what is joined stays far below them."""
    joined = []
    for n in (1000, 4000):
        legs = spark.range(n).selectExpr("concat('A', id) AS icao_hex", "DATE'2024-01-01' AS service_date", "1L AS segment", "timestampadd(MINUTE, CAST(id % 30 AS INT), timestamp_ntz'2024-01-01 10:00:00') AS start_ts", "timestamp_ntz'2024-01-01 12:00:00' AS end_ts", "CAST(NULL AS STRING) AS registration", "'AAL1' AS callsign", "'departure' AS direction")
        rows = spark.range(n).selectExpr("id AS schedule_key", "DATE'2024-01-01' AS flight_date", "'AAL1' AS flight_icao", "'AA1' AS flight_iata", "'AAL' AS airline_icao", "'AA' AS airline_iata", "'1' AS flight_number", "CAST(NULL AS STRING) AS sched_registration", "'TST' AS dep_airport", "'OTH' AS arr_airport", "timestampadd(MINUTE, CAST(id % 20 AS INT), timestamp_ntz'2024-01-01 10:00:00') AS dep_scheduled", "timestamp_ntz'2024-01-01 12:00:00' AS arr_scheduled")
        found = matching.best_matches(legs, rows, ["TST"])
        assert len(found.collect()) == n
        joined.append(_joined_rows(found))
    assert 0 < joined[1] < 8 * 4000


def _gates(spark, n):
    """``n`` gates at five positions, one of them twice and one at two positions; all points near some."""
    gates = spark.range(n).selectExpr("id + 1 AS gate_id", "32.0 + (id % 5) * 0.0004 AS lat", "-117.0 AS lon")
    gates = gates.unionByName(gates.where("gate_id = 7")).unionByName(spark.sql("SELECT 3L AS gate_id, 32.0008D AS lat, -117.0D AS lon"))
    points = spark.range(40).selectExpr("id AS event_id", "concat('F', id % 4) AS flight_id", "DATE'2024-01-01' AS service_date", "timestampadd(MINUTE, CAST(id AS INT), timestamp_ntz'2024-01-01 10:00:00') AS ts", "32.0 + (id % 9) * 0.0003 AS lat", "-117.0 + (id % 7) * 0.0002 AS lon")
    return points, gates


@pytest.mark.parametrize("broadcast", [True, False])
def test_crowded_gates(spark, monkeypatch, broadcast):
    """Many gates at one position: all pairs, the nearest gate and the gate of most points are as by brute force."""
    from airside.functions import geo
    from airside.operators import spatial
    from airside.plans import flight_pages

    monkeypatch.setattr(spatial, "PIECE", 8)
    if not broadcast:
        monkeypatch.setattr(spatial, "BROADCAST_PLACES", 0)
        monkeypatch.setattr(spatial, "BROADCAST_IDS", 0)
    points, gates = _gates(spark, 100)
    far = geo.distance_m(F.col("lat"), F.col("lon"), F.col("y"), F.col("x"))
    pairs = points.crossJoin(gates.selectExpr("gate_id", "lat AS y", "lon AS x")).withColumn("m", far).where("m <= 60").collect()
    got = spatial.places_within(points, gates, 60)
    assert sorted((r["event_id"], r["gate_id"]) for r in got.collect()) == sorted((r["event_id"], r["gate_id"]) for r in pairs) and len(pairs) > 500
    assert "_held" not in got.columns and "g_lat" not in got.columns
    best = {}
    for r in pairs:
        best[r["event_id"]] = min(best.get(r["event_id"], (1e9, 0)), (r["m"], r["gate_id"]))
    assert {r["event_id"]: r["gate_id"] for r in spatial.nearest_place(points, "event_id", gates, 60).collect() if r["gate_id"]} == {k: v[1] for k, v in best.items()}
    count = {}
    for r in pairs:
        count[r["flight_id"], r["gate_id"]] = count.get((r["flight_id"], r["gate_id"]), 0) + 1
    most = {f: min((-n, g) for (f2, g), n in count.items() if f2 == f) for f, _ in count}
    assert {r["flight_id"]: (-r["points"], r["gate_id"]) for r in flight_pages.flight_gate_dwell(points, gates, 60).collect()} == most


def test_gates_of_a_position_are_compared_once(spark):
    """Four times the gates at the same positions: no more rows come out of the joins with points."""
    from airside.operators import spatial
    from airside.plans import flight_pages

    made = []
    for n in (100, 400):
        points, gates = _gates(spark, n)
        found = flight_pages.flight_gate_dwell(points, gates, 60)
        near = spatial.nearest_place(points, "event_id", gates, 60)
        assert found.count() and len(found.collect()) == 4 and len(near.collect()) == 40
        made.append(_joined_rows(found))
    assert made[0] and made[1] <= made[0] + 40
