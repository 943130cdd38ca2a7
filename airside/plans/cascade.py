"""The derived tables, refreshed in the order of their dependence, and only where something changed.

Every table is kept by day (see ``sources.versions``). With each day goes a fingerprint of its rows
and a note of the fingerprints it was made from. A refresh works through the tables in order and,
of each, makes only the days anew whose sources have other fingerprints now, reading only the days
of the sources that these need. A day that comes out as it was keeps its files, so what depends on
it alone isn't made anew either.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airside.functions import flight as fl
from airside.operators import enrichment, gold, matching, sessions, spatial
from airside.sources.versions import Manifest, VersionedTable

#: The day under which a table without days is kept.
WHOLE = "1970-01-01"


@dataclass
class Airport:
    """What the derived tables need to know besides points and schedule."""

    codes: list[str]
    tz: str
    ring: Column
    gates: DataFrame
    runways: DataFrame
    airlines: DataFrame
    prior_least: int = 5


@dataclass
class Step:
    """A derived table: its sources with the days before and after a day that it takes from them (None: all days)."""

    sources: dict[str, tuple[int, int] | None]
    make: Callable[[dict[str, DataFrame], Airport], DataFrame]
    day: str = "service_date"


SAME = (0, 0)


def _delays(t: dict[str, DataFrame], a: Airport) -> DataFrame:
    return gold.airline_delay_daily(t["schedule"], t["legs"], a.codes[0])


def _dwell(t: dict[str, DataFrame], a: Airport) -> DataFrame:
    return enrichment.flight_dwell_with_airline(t["ground_points"], t["flight_gate_time"], t["adsb_local"], a.airlines)


def _enriched(t: dict[str, DataFrame], a: Airport) -> DataFrame:
    points = t["points"].drop("service_date")
    return enrichment.enrich_points(points, t["legs"], t["matches"], t["schedule"], t["prior"].drop("service_date"), a.airlines, a.tz, a.codes)


def _hourly(t: dict[str, DataFrame], a: Airport) -> DataFrame:
    return gold.traffic_hourly(t["points"]).withColumn("utc_date", F.to_date("hour"))


def _crossings(t: dict[str, DataFrame], a: Airport) -> DataFrame:
    keyed = t["points"].withColumn("flight_key", fl.aircraft_day_id(F.col("icao_hex"), F.col("service_date")))
    days = keyed.select("flight_key", "service_date").distinct()
    return spatial.runway_crossings(keyed, a.runways).join(days, "flight_key")


#: In the order of their dependence; the first four are the canonical layer, the others the derived tables.
STEPS: dict[str, Step] = {
    "legs": Step({"points": SAME}, lambda t, a: sessions.flight_legs(t["points"].drop("service_date"), a.tz, a.ring)),
    "matches": Step({"legs": SAME, "schedule": (1, 1)}, lambda t, a: matching.best_matches(t["legs"], t["schedule"], a.codes)),
    "prior": Step({"legs": None, "matches": None, "schedule": None}, lambda t, a: matching.callsign_prior(t["legs"], t["matches"], t["schedule"], a.prior_least).withColumn("service_date", F.lit(WHOLE).cast("date"))),
    "enriched": Step({"points": SAME, "legs": SAME, "matches": SAME, "schedule": (1, 1), "prior": None}, _enriched),
    "adsb_local": Step({"enriched": SAME}, lambda t, a: enrichment.adsb_local(t["enriched"], a.ring)),
    "ground_sessions": Step({"points": SAME}, lambda t, a: sessions.ground_sessions(t["points"].drop("service_date"), a.tz)),
    "ground_points": Step({"points": SAME}, lambda t, a: gold.gate_points(t["points"].drop("service_date"), a.gates, a.tz)),
    "flight_gate_time": Step({"ground_points": SAME}, lambda t, a: gold.flight_gate_time(t["ground_points"])),
    "gate_util_daily": Step({"ground_points": SAME}, lambda t, a: gold.gate_util_daily(t["ground_points"])),
    "gate_airline_dwell_daily": Step({"ground_points": SAME, "adsb_local": SAME}, lambda t, a: gold.gate_airline_dwell_daily(t["ground_points"], t["adsb_local"])),
    "flight_dwell_with_airline": Step({"ground_points": SAME, "flight_gate_time": SAME, "adsb_local": SAME}, _dwell),
    "traffic_daily": Step({"points": SAME}, lambda t, a: gold.traffic_daily(t["points"].drop("service_date"), a.tz)),
    "traffic_hourly": Step({"points": (1, 1)}, _hourly, "utc_date"),
    "flight_list": Step({"adsb_local": SAME}, lambda t, a: gold.flight_list(t["adsb_local"], a.ring)),
    "airline_traffic_daily": Step({"points": SAME}, lambda t, a: gold.airline_traffic_daily(t["points"].drop("service_date"), a.tz)),
    "airline_delay_daily": Step({"schedule": SAME, "legs": SAME}, _delays, "flight_date"),
    "runway_crossings": Step({"points": SAME}, _crossings),
}
SILVER = ("legs", "matches", "prior", "enriched")


def _around(day: str, window: tuple[int, int]) -> list[str]:
    at = date.fromisoformat(day)
    return [(at + timedelta(days=n)).isoformat() for n in range(-window[0], window[1] + 1)]


def fingerprints(table: VersionedTable, folders: dict[str, str]) -> dict[str, str]:
    """Of each day: number of rows and sum of their hashes, which no order of rows changes. One row a day comes back."""
    if not folders:
        return {}
    rows = table._read(list(folders.values()))
    sums = rows.groupBy(table.day).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("h"))
    return {str(r[table.day]): f"{r['n']}:{r['h']}" for r in sums.collect()}


class Cascade:
    """Tables below ``root``: the sources ``points`` and ``schedule``, and all derived ones by name."""

    def __init__(self, spark: SparkSession, root: str, airport: Airport):
        self.spark, self.root, self.airport = spark, root, airport
        self.tables: dict[str, VersionedTable] = {}

    def source(self, name: str, rows: DataFrame, day: str) -> VersionedTable:
        """A source table, for its owner to merge into; made at first mention."""
        return self.tables.setdefault(name, VersionedTable(self.spark, f"{self.root}/{name}", rows.schema, day))

    def _prints(self, name: str) -> dict[str, str]:
        """Fingerprints by day. Folders are never changed, so that the known ones are looked up by folder."""
        table = self.tables[name]
        found = table.manifest()
        known = found.notes.get("prints", {})
        open_ = {d: f for d, f in found.days.items() if known.get(d, [None])[0] != f}
        fresh = fingerprints(table, open_)
        if open_:
            known = {d: known[d] if d not in open_ else [f, fresh.get(d, "")] for d, f in found.days.items()}
            table.publish(found, {}, notes={"prints": known})
        return {d: known[d][1] for d in found.days}

    def refresh(self) -> dict[str, list[str]]:
        """Bring all derived tables up to date; the days of each that came out other than they were."""
        prints = {name: self._prints(name) for name in ("points", "schedule")}
        return {name: self._refresh(name, step, prints) for name, step in STEPS.items()}

    def _refresh(self, name: str, step: Step, prints: dict[str, dict[str, str]]) -> list[str]:
        wholly = all(w is None for w in step.sources.values())
        # A day of the table can come from any day of its sources in the window around it.
        days = {WHOLE} if wholly else {d for s, w in step.sources.items() if w is not None for day in prints[s] for d in _around(day, (w[1], w[0]))}

        def origin(day: str) -> str:
            read = [(s, d, p) for s, w in step.sources.items() for d, p in sorted(prints[s].items()) if w is None or d in set(_around(day, w))]
            return hashlib.sha256(repr(read).encode()).hexdigest()

        origins = {d: origin(d) for d in sorted(days)}
        table = self.tables.get(name) or VersionedTable.existing(self.spark, f"{self.root}/{name}", step.day)
        found = table.manifest() if table else Manifest()
        made_from = found.notes.get("from", {})
        stale = [d for d in sorted(set(origins) | set(made_from)) if origins.get(d) != made_from.get(d)]
        if table and not stale:
            self.tables[name] = table
            prints[name] = {d: found.notes["prints"][d][1] for d in found.days}
            return []
        inputs = {}
        for source, window in step.sources.items():
            needed = None if window is None or wholly else sorted({x for d in stale for x in _around(d, window)})
            inputs[source] = self.tables[source].read(days=needed)
        rows = step.make(inputs, self.airport)
        table = self.tables[name] = table or VersionedTable(self.spark, f"{self.root}/{name}", rows.schema, step.day)
        rows = rows.where(F.col(step.day).isin([date.fromisoformat(d) for d in stale]))  # days that were read for their neighbours only are not this table's
        staged = table.stage(rows)
        fresh = fingerprints(table, staged)
        known = found.notes.get("prints", {})
        same = {d for d in stale if d in found.days and d in staged and known.get(d, [None, None])[1] == fresh[d]}
        changed = [d for d in stale if d not in same and (d in staged or d in found.days)]
        kept = {d: x for d, x in known.items() if d in found.days and d not in changed} | {d: [staged[d], fresh[d]] for d in changed if d in staged}
        table.publish(found, {d: staged.get(d) for d in changed}, notes={"prints": kept, "from": origins})
        prints[name] = {d: x[1] for d, x in kept.items()}
        return changed
