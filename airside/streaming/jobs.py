"""Streaming forms of ingestion, deduplication, traffic, sessions, legs, upserts and late rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from airside.functions import flight as fl
from airside.functions.time import service_date
from airside.operators.gold import SKETCH_BITS
from airside.operators.sessions import GAP_MINUTES
from airside.sources.files import live_snapshot_parse
from airside.sources.versions import VersionedTable


def stream_positions(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Positions from a folder of payload files; the file's time is the time of observation."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path, wholetext=True)
    return live_snapshot_parse(raw.select("value", F.col("_metadata.file_modification_time").alias("fetched_at")))


def stream_dedup(points: DataFrame, late: str = "2 hours") -> DataFrame:
    return points.withWatermark("ts", late).dropDuplicatesWithinWatermark(["icao_hex", "ts"])


def stream_hourly(points: DataFrame, late: str = "2 hours") -> DataFrame:
    """Records and a sketch of the aircraft, by hour: stored ones merge to days and ranges (``reports.traffic_of_days``)."""
    counted = points.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"))
    return counted.agg(F.count("*").alias("records"), F.hll_sketch_agg("icao_hex", F.lit(SKETCH_BITS)).alias("aircraft_sketch")).select(F.col("window.start").alias("hour"), "records", "aircraft_sketch")


def stream_sessions(ground: DataFrame, tz: str, late: str = "2 hours") -> DataFrame:
    """Ground sessions of an aircraft's airport-local day; minutes are cut off first, so that the gap
    is counted in minute boundaries."""
    dated = ground.withColumn("service_date", service_date(F.col("ts").cast("timestamp_ntz"), tz))
    cut = dated.withColumn("minute", F.date_trunc("minute", "ts")).withWatermark("minute", late)
    found = cut.groupBy("icao_hex", "service_date", F.session_window("minute", f"{GAP_MINUTES} minutes 1 second"))
    return found.agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("points")).drop("session_window")


#: Times are microseconds and days are numbers since 1970 within the state.
_LEG = "icao_hex string, day int, segment long, start_us long, end_us long, points long"
_POINT = "event_id long, us long, day int, ground boolean"
_OPEN = "day int, segment long, ground boolean, start_us long, last_us long, points long, closed boolean"
_MINUTE_US = 60_000_000
#: No point of a local day comes so long after one of it.
_DAY_OVER_MS = 36 * 3600 * 1000


def next_segments(points: pd.DataFrame, before: tuple | None) -> tuple[list[tuple], tuple]:
    """The segments that end with these points, and the one that stays open.

    ``points`` (us, day, ground) are in order and follow the segment ``before``. Breaks are found as in batch:
    by differences to the point before, and running sums of them.
    """
    minute, day, ground = points["us"].to_numpy() // _MINUTE_US, points["day"].to_numpy(), points["ground"].to_numpy(bool)
    us = points["us"].to_numpy()
    known = before is not None
    last = (before[4] // _MINUTE_US, before[0], before[2]) if known else (minute[0], day[0], ground[0])
    earlier = [np.concatenate([[b], x[:-1]]) for b, x in zip(last, (minute, day, ground), strict=True)]
    new_day = day != earlier[1]
    opens = new_day | (minute - earlier[0] > GAP_MINUTES) | (ground != earlier[2])
    if not known:
        opens[0] = new_day[0] = True
    count = np.cumsum(opens)
    of_day = np.maximum.accumulate(np.where(new_day, count, 0))  # the count at the first point of its day
    number = np.where(of_day > 0, count - of_day + 1, count + (before[1] if known else 0))
    starts = np.flatnonzero(opens)
    ends = np.concatenate([starts[1:], [len(us)]]) if len(starts) else starts
    done = [before[:6]] if known and len(starts) and not before[6] else []
    if known and not opens[0]:  # its first points go on with what was open
        more = int(starts[0]) if len(starts) else len(us)
        grown = (*before[:4], int(us[more - 1]), before[5] + more)
        done, before = ([grown] if len(starts) else []), (*grown, False)
    done += [(int(day[a]), int(number[a]), bool(ground[a]), int(us[a]), int(us[z - 1]), int(z - a)) for a, z in zip(starts, ends, strict=True)]
    return (done[:-1], (*done[-1], False)) if len(starts) else ([], before)


class LegProcessor(StatefulProcessor):
    """The legs of one aircraft: points wait in a list until the watermark has passed them, in whatever order they
    come; an event-time timer then takes them in order of time through the open segment. Other timers
    close a segment when no point can follow it within the gap, and forget an aircraft when its day is over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _POINT)
        self.kept = handle.getValueState("kept", f"alarm long, {_OPEN}")  # the one timer, and the open segment (or nulls)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for r in rows:
            self.waiting.appendList([(int(e), int(u), int(d), bool(g)) for e, u, d, g in zip(r["event_id"], r["us"], r["day"], r["ground"], strict=True)])
            first = min(x for x in (first, int(r["us"].min())) if x is not None)
        due = -(-first // 1000)
        kept = self.kept.get() or (None,) * 8
        if kept[0] is None or due < kept[0]:
            if kept[0] is not None:
                self.handle.deleteTimer(kept[0])
            self.handle.registerTimer(due)
            self.kept.update((due, *kept[1:]))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        points = pd.DataFrame(list(self.waiting.get()), columns=["event_id", "us", "day", "ground"])
        ready = points["us"] <= mark * 1000
        later = points[~ready]
        kept = self.kept.get()
        done, now = [], tuple(kept[1:]) if kept and kept[1] is not None else None
        if ready.any():
            done, now = next_segments(points[ready].sort_values(["us", "event_id"]), now)
            if len(later):
                self.waiting.put([(int(e), int(u), int(d), bool(g)) for e, u, d, g in later.itertuples(index=False)])
            else:
                self.waiting.clear()
        due = [-(-int(later["us"].min()) // 1000)] if len(later) else []
        if now and not now[6]:
            if mark * 1000 // _MINUTE_US - now[4] // _MINUTE_US > GAP_MINUTES:
                done, now = [*done, now[:6]], (*now[:6], True)
            else:
                due.append((now[4] // _MINUTE_US + GAP_MINUTES + 1) * 60_000)
        over = now[4] // 1000 + _DAY_OVER_MS if now else 0
        if now and (mark <= over or due):
            alarm = max(min([*due, over]), mark + 1)
            self.handle.registerTimer(alarm)  # the one that rang is gone
            self.kept.update((alarm, *now))
        elif due:
            self.handle.registerTimer(max(min(due), mark + 1))
            self.kept.update((max(min(due), mark + 1), *(None,) * 7))
        else:
            self.kept.clear()  # the aircraft's day is over
        legs = [(key[0], *s[:2], *s[3:]) for s in done if not s[2]]
        yield pd.DataFrame(legs, columns=["icao_hex", "day", "segment", "start_us", "end_us", "points"])

    def close(self) -> None:
        pass


def stream_legs(points: DataFrame, tz: str, late: str = "10 minutes") -> DataFrame:
    """Airborne segments as they end: the batch rule as a state for each aircraft.

    Points have event_id, icao_hex, ts, velocity, altitude_baro and come in any order within
    ``late``; rows behind the watermark are dropped. A segment ends with a change of ground state,
    a new day, a gap, or when the watermark is a gap past its last point. Keeps its state in RocksDB.
    """
    points.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    day = F.date_diff(service_date(F.col("ts").cast("timestamp_ntz"), tz), F.lit("1970-01-01").cast("date"))
    marked = points.withWatermark("ts", late).select("event_id", "icao_hex", "ts", F.unix_micros("ts").alias("us"), day.alias("day"), fl.is_ground_leg(F.col("velocity"), F.col("altitude_baro")).alias("ground"))
    legs = marked.groupBy("icao_hex").transformWithStateInPandas(LegProcessor(), outputStructType=_LEG, outputMode="Append", timeMode="EventTime")
    return legs.select(
        "icao_hex", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")).alias("service_date"), "segment", F.timestamp_micros("start_us").alias("start_ts"), F.timestamp_micros("end_us").alias("end_ts"), "points"
    )


def stream_upsert(points: DataFrame, table: VersionedTable, how: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str, writer: str = "stream") -> StreamingQuery:
    """Merge every micro-batch into a table by ``how(known, new)``; see ``VersionedTable.merge``.

    Only the days that a micro-batch touches are written. One that comes again after a failure finds its number in
    the table's manifest and changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        batch.persist()
        table.merge(batch, how, writer, number)
        batch.unpersist()

    return points.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_late(points: DataFrame, table: VersionedTable, side: VersionedTable, checkpoint: str, delay: str = "2 hours", again: Callable[[list[str]], None] | None = None, writer: str = "late") -> StreamingQuery:
    """Keep points by day, tell late ones apart, and work the days they touch through again.

    The watermark of a micro-batch is the greatest ``ts`` of all before it less ``delay``, as the
    engine has it; it stands in the manifest of ``table``, so that a restarted query goes on with it. Rows
    at or behind it go to ``side`` and to ``table``, the others to ``table`` alone; then
    ``again(days)`` is called with the days that late rows have touched. Both tables know the numbers
    of their batches: one that comes again is written to neither twice.
    """
    def take(batch: DataFrame, number: int) -> None:
        batch.persist()
        found = table.manifest()
        mark = found.notes.get("watermark")
        behind = F.col("ts") <= F.timestamp_micros(F.lit(mark)) if mark is not None else F.lit(False)
        late = batch.where(behind)
        add = lambda known, new: known.unionByName(new)
        side.merge(late, add, writer, number)
        if number > found.batches.get(writer, -1):
            ahead = batch.agg(F.unix_micros(F.max("ts") - F.expr(f"INTERVAL {delay}"))).first()[0]
            marks = [m for m in (mark, ahead) if m is not None]
            table.merge(batch, add, writer, number, {"watermark": max(marks)} if marks else None)
        touched = sorted(str(r[0]) for r in late.select(table.day).distinct().collect())
        if again and touched:
            again(touched)
        batch.unpersist()

    return points.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
