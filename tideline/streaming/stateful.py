"""Dwell sessions, tracklets and presence on streams, with typed state and event-time timers.

A vessel's fixes wait in its state until the watermark has passed them and are then taken in the order of their time,
so what arrives late (within the watermark's delay) changes nothing: the results are those of the batch operators in
``geofence``, whose rules for one fix these processors share. State is kept by fix, session or polygon, each entry
written for itself. A timer at the earliest waiting fix wakes a vessel; nothing is told of vessels that stay silent.

Cases: fixes without id, time or position are left out; fixes beyond the watermark are dropped by Spark; of fixes at one
time the order is by position, then speed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import astuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tideline.streaming import geofence
from tideline.streaming.geofence import Rules, Track, Visit

FIX = ("t", "lat", "lon", "sog", "cog", "is_tanker")
FIX_DDL = "t double, lat double, lon double, sog double, cog double, is_tanker boolean"
SESSION_DDL = "entered double, last double, lon double, lat double"
VISIT_DDL = "hits int, misses int, inside boolean, entered double, gone double, seen double, n long, low double, high double, total double, speeds long"


class InOrder(StatefulProcessor):
    """Keeps a vessel's fixes until the watermark has passed them, then gives them to ``told`` in order.

    ``begin`` and ``end`` stand around the fixes of one wake-up: there subclasses read and write their state.
    """

    def __init__(self, rules: Rules, make: Callable[[list], pd.DataFrame]):
        self.rules, self.make = rules, make

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.waiting = handle, handle.getListState("waiting", FIX_DDL)
        self.open(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        earliest = math.inf
        for frame in rows:
            fixes = [tuple(None if v is None or v != v else v for v in fix) for fix in zip(*(frame[c].tolist() for c in FIX))]
            self.waiting.appendList(fixes)
            earliest = min(earliest, min(fix[0] for fix in fixes))
        self.handle.registerTimer(max(math.ceil(earliest * 1000), timerValues.getCurrentWatermarkInMs() + 1))
        yield self.make([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() / 1000
        fixes = sorted(self.waiting.get(), key=lambda f: (f[0], f[1], f[2], -math.inf if f[3] is None else f[3]))
        due = [f for f in fixes if f[0] <= now]
        if len(due) < len(fixes):
            self.waiting.put(fixes[len(due) :])
            self.handle.registerTimer(max(math.ceil(fixes[len(due)][0] * 1000), timerValues.getCurrentWatermarkInMs() + 1))
        else:
            self.waiting.clear()
        self.begin()
        found = [row for fix in due for row in self.told(key[0], *fix)]
        self.end()
        yield self.make(found)

    def close(self) -> None:
        pass

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def begin(self) -> None:
        raise NotImplementedError

    def told(self, mmsi, t, lat, lon, sog, cog, is_tanker) -> list[tuple]:
        raise NotImplementedError

    def end(self) -> None:
        raise NotImplementedError

    def within(self, lon: float, lat: float) -> list[int]:
        return [i for i, p in enumerate(self.rules.polygons) if geofence.holds(p, lon, lat)]


class Dwells(InOrder):
    """Sessions by polygon."""

    def open(self, handle):
        self.sessions = handle.getMapState("sessions", "polygon int", SESSION_DDL)

    def begin(self):
        self.own = {k[0]: list(v) for k, v in self.sessions.iterator()}
        self.before = {k: list(v) for k, v in self.own.items()}

    def told(self, mmsi, t, lat, lon, sog, cog, is_tanker):
        stays = geofence.stay(self.own, self.rules, t, lat, lon, sog, self.within(lon, lat))
        return [row for left in stays for row in geofence.dwell_row(self.rules, mmsi, *left)]

    def end(self):
        write(self.sessions, self.before, {k: tuple(v) for k, v in self.own.items()})


class Sampled(InOrder):
    """Takes the first fix of each bucket, from a vessel's first fix as a tanker on."""

    def open(self, handle):
        self.sampling = handle.getValueState("sampling", "bucket long, tanker boolean, told double")

    def begin(self):
        self.bucket, self.tanker, self.last = self.sampling.get() or (-1, False, None)

    def takes(self, t: float, is_tanker: bool | None) -> bool:
        self.tanker = self.tanker or bool(is_tanker)
        bucket = int(t // self.rules.downsample_s)
        if not self.tanker or bucket <= self.bucket:
            return False
        self.bucket = bucket
        return True

    def end(self):
        self.sampling.update((self.bucket, self.tanker, self.last))


class Tracklets(Sampled):
    """The fixes of the longest span, and where the last tracklet ended."""

    def open(self, handle):
        super().open(handle)
        self.kept = handle.getListState("track", "t double, sog double, course double")

    def begin(self):
        super().begin()
        self.track = Track(self.kept.get(), self.last)

    def told(self, mmsi, t, lat, lon, sog, cog, is_tanker):
        return self.track.piece(self.rules, mmsi, t, sog, cog) if self.takes(t, is_tanker) else []

    def end(self):
        self.last = self.track.told
        super().end()
        if self.track.fixes:
            self.kept.put(list(self.track.fixes))


class Presences(Sampled):
    """Visits by polygon; rows are numbered for each vessel, for a sink that keeps the last of each key."""

    def open(self, handle):
        super().open(handle)
        self.visits = handle.getMapState("visits", "polygon int", VISIT_DDL)

    def begin(self):
        super().begin()
        self.own = {k[0]: Visit(*v) for k, v in self.visits.iterator()}
        self.before = {k: astuple(v) for k, v in self.own.items()}

    def told(self, mmsi, t, lat, lon, sog, cog, is_tanker):
        out = []
        for row in geofence.presence_of(self.own, self.rules, mmsi, t, sog, self.within(lon, lat)) if self.takes(t, is_tanker) else ():
            self.last = (self.last or 0.0) + 1
            out.append((*row, int(self.last)))
        return out

    def end(self):
        super().end()
        write(self.visits, self.before, {k: astuple(v) for k, v in self.own.items()})


def write(state, before: dict, now: dict) -> None:
    """Entries of a map state that changed since they were read."""
    for k in before.keys() - now.keys():
        state.removeKey((k,))
    for k, value in now.items():
        if before.get(k) != value:
            state.updateValue((k,), value)


def _stream(fixes: DataFrame, processor: InOrder, ddl: str, late: str) -> DataFrame:
    fixes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = geofence.usable(fixes).withWatermark("ts", late)
    return rows.groupBy("mmsi").transformWithStateInPandas(processor, ddl, "append", "EventTime")


def dwell_session_stream(fixes: DataFrame, rules: Rules, late: str = "10 minutes") -> DataFrame:
    """``geofence.dwell_sessions`` on a stream (open stays stay open). Sets the session's state store to RocksDB, which typed state needs."""
    make = geofence._timed(geofence.DWELL_DDL, "ts_in", "ts_out")
    return _stream(fixes, Dwells(rules, make), geofence.DWELL_DDL, late)


def tracklet_stream(fixes: DataFrame, rules: Rules, late: str = "10 minutes") -> DataFrame:
    """``geofence.tracklets`` on a stream."""
    make = geofence._timed(geofence.TRACKLET_DDL, "start_ts", "end_ts")
    return _stream(fixes, Tracklets(rules, make), geofence.TRACKLET_DDL, late)


def presence_stream(fixes: DataFrame, rules: Rules, late: str = "10 minutes") -> DataFrame:
    """``geofence.presence_upserts`` on a stream, for a keyed sink that keeps the row with the last ``nth`` of each vessel and polygon."""
    ddl = f"{geofence.PRESENCE_DDL}, nth long"
    return _stream(fixes, Presences(rules, geofence._timed(ddl, "enter_ts", "exit_ts", "last_seen_ts")), ddl, late)
