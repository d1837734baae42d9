"""Geofence state machines per vessel: polygon entries and exits with hysteresis, gate crossings, dwell sessions, tracklets.

What a fix says on its own or beside the one before (polygons that hold it, gates that the move crosses, an
implausible speed) is column maths; only what depends on all that came before goes through Python. Batch operators
sort each vessel's fixes and stream them, with the state carried from one Arrow batch to the next; the streaming
operator keeps the state in Spark (``applyInPandasWithState``). Time is the fixes' own; on streams a silent vessel
expires when the watermark passes.

Cases: fixes without id, time or position are left out; of fixes at one time the order is by position, then speed.
"""

from __future__ import annotations

import datetime as dt
import json
import math
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideline.functions.columns import EARTH_NM, MERCATOR_RADIUS_M, haversine
from tideline.operators.geo import in_ring, mercator, ring_distance

EVENT_DDL = "mmsi long, kind string, place_id string, event string, ts timestamp, lat double, lon double, sog double"
DWELL_DDL = "mmsi long, polygon_id string, kind string, ts_in timestamp, ts_out timestamp, dwell_min long, lon double, lat double"
TRACKLET_DDL = "tracklet_id string, mmsi long, start_ts timestamp, end_ts timestamp, n_points long, mean_cog_deg double, mean_sog double"
PRESENCE_DDL = (
    "mmsi long, polygon_id string, enter_ts timestamp, exit_ts timestamp, last_seen_ts timestamp, inside boolean, samples_inside long, sog_min double, sog_max double, sog_avg double"
)
STATE_DDL = "state string"


@dataclass(frozen=True)
class Polygon:
    polygon_id: str
    ring: tuple[tuple[float, float], ...]
    anchorage: bool = False
    kind: str = "terminal"
    min_dwell_min: int = 0
    #: Metres of the projection around the ring that count as inside.
    buffer_m: float = 0.0


@dataclass(frozen=True)
class Gate:
    gate_id: str
    a: tuple[float, float]
    b: tuple[float, float]
    buffer_m: float = 0.0


@dataclass(frozen=True)
class Rules:
    polygons: tuple[Polygon, ...] = ()
    gates: tuple[Gate, ...] = ()
    downsample_s: int = 60
    hits: int = 2
    ttl_s: int = 30 * 60
    anchorage_ttl_s: int = 90 * 60
    gate_repeat_s: int = 5 * 60
    spoof_kn: float = 40.0
    #: Dwell sessions: a slow vessel this near its last place inside stays, and a silence longer than this ends at that place.
    stay_nm: float = 0.5
    stay_kn: float = 1.0
    silent_s: int = 15 * 60
    #: Tracklets: spans in seconds.
    tracklet_s: tuple[int, int] = (5 * 60, 15 * 60)


@dataclass
class VesselState:
    last_bucket: int = -1
    tanker: bool = False
    last: list[float] | None = None  # seconds, lat, lon
    runs: dict[str, list] = field(default_factory=dict)  # polygon: hits in a row, misses in a row, inside, last seen inside
    emitted: dict[str, float] = field(default_factory=dict)  # gate and direction: seconds of the last crossing told

    def dump(self) -> str:
        return json.dumps(self.__dict__)

    @staticmethod
    def load(text: str) -> VesselState:
        return VesselState(**json.loads(text))


def inside(ring: tuple[tuple[float, float], ...], x: float, y: float) -> bool:
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def holds(polygon: Polygon, lon: float, lat: float) -> bool:
    """As ``held_by``, of one place."""
    if not polygon.buffer_m:
        return inside(polygon.ring, lon, lat)
    x, y = metres(lon, lat)
    ring = tuple(metres(*q) for q in polygon.ring)
    if inside(ring, x, y):
        return True
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        dx, dy = x2 - x1, y2 - y1
        part = min(1.0, max(0.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy or 1.0)))
        if math.hypot(x - x1 - part * dx, y - y1 - part * dy) <= polygon.buffer_m:
            return True
    return False


def metres(lon: float, lat: float) -> tuple[float, float]:
    return MERCATOR_RADIUS_M * math.radians(lon), MERCATOR_RADIUS_M * math.log(math.tan(math.pi / 4 + math.radians(lat) / 2))


def _side(o, d, t):
    """On which side of the line from o to d the point t lies (floats or columns)."""
    return (d[0] - o[0]) * (t[1] - o[1]) - (d[1] - o[1]) * (t[0] - o[0])


def _ends_and_normal(gate: Gate) -> tuple[tuple[float, float], tuple[float, float], tuple[float, float]]:
    """Ends of a gate in metres and its normal, which points to the left of the way from a to b."""
    a, b = metres(*gate.a), metres(*gate.b)
    length = math.hypot(b[0] - a[0], b[1] - a[1])
    return a, b, (-(b[1] - a[1]) / length, (b[0] - a[0]) / length) if length else (0.0, 0.0)


def _way(gate: Gate, before: tuple[Column, Column], now: tuple[Column, Column], course: Column) -> Column:
    """Direction in which the move between two places (metres) crosses the gate or comes within its buffer; null if it doesn't.

    The move's component along the gate's normal tells the direction; without a move the course stands for it.
    """
    a, b, normal = _ends_and_normal(gate)
    a, b = tuple(map(F.lit, a)), tuple(map(F.lit, b))
    meets = (_side(a, b, before) * _side(a, b, now) <= 0) & (_side(before, now, a) * _side(before, now, b) <= 0)
    if gate.buffer_m and any(normal):
        low, high = F.lit(0.0), F.lit(1.0)
        for start, move, least, most in _in_gate(gate, before, now):
            one, two = F.try_divide(least - start, move), F.try_divide(most - start, move)
            beside = (move == 0) & ~start.between(least, most)
            low = F.when(beside, 2.0).otherwise(F.greatest(low, F.least(one, two)))
            high = F.least(high, F.greatest(one, two))
        meets = meets | (low <= high)
    dx, dy = now[0] - before[0], now[1] - before[1]
    moved = F.hypot(dx, dy) > 0
    along = F.when(moved, dx * normal[0] + dy * normal[1]).otherwise(
        F.cos(F.radians(course)) * normal[0] + F.sin(F.radians(course)) * normal[1]
    )
    return F.when(meets & (along >= 0), "AtoB").when(meets & (along < 0), "BtoA")


def _in_gate(gate: Gate, before, now) -> list[tuple]:
    """Along the gate, then across it: where a move begins, its part that way, and the bounds of the gate's strip, which ends flat at the gate's ends."""
    a, b, normal = _ends_and_normal(gate)
    length, out = math.hypot(b[0] - a[0], b[1] - a[1]), []
    for way, least, most in (((normal[1], -normal[0]), 0.0, length), (normal, -gate.buffer_m, gate.buffer_m)):
        start, end = ((p[0] - a[0]) * way[0] + (p[1] - a[1]) * way[1] for p in (before, now))
        out.append((start, end - start, least, most))
    return out


def knots(seconds: float, lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a, b = math.radians(lat1), math.radians(lat2)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 3440.065 * math.asin(min(1.0, math.sqrt(h))) / (seconds / 3600) if seconds > 0 else 0.0


def expire(state: VesselState, rules: Rules, now: float) -> Iterator[tuple]:
    """Exits of polygons not seen inside for their time to live, stamped with the last time seen."""
    anchorages = {p.polygon_id for p in rules.polygons if p.anchorage}
    for polygon_id, run in state.runs.items():
        if run[2] and now - run[3] > (rules.anchorage_ttl_s if polygon_id in anchorages else rules.ttl_s):
            run[:3] = [0, 0, False]
            yield "polygon", polygon_id, "exit", run[3], *state.last[1:], None


def advance(
    state: VesselState, rules: Rules, t: float, lat: float, lon: float, sog: float | None, within: set[str], ways: list[tuple[str, str]], jump: bool
) -> Iterator[tuple]:
    """Events of one fix: kind, place, event, seconds, lat, lon, sog. ``within`` names the polygons that hold it, ``ways`` gates and directions crossed."""
    if state.last is not None:
        yield from expire(state, rules, t)
    if jump:
        yield "spoof", "", "jump", t, lat, lon, sog
    for polygon_id in within:
        run = state.runs.setdefault(polygon_id, [0, 0, False, t])
        run[0], run[1], run[3] = run[0] + 1, 0, t
        if not run[2] and run[0] >= rules.hits:
            run[2] = True
            yield "polygon", polygon_id, "enter", t, lat, lon, sog
    for polygon_id, run in state.runs.items():
        if polygon_id not in within:
            run[0], run[1] = 0, run[1] + 1
            if run[2] and run[1] >= rules.hits:
                run[2] = False
                yield "polygon", polygon_id, "exit", t, lat, lon, sog
    for gate_id, way in ways:
        key = f"{gate_id}|{way}"
        if t - state.emitted.get(key, -math.inf) >= rules.gate_repeat_s:
            state.emitted[key] = t
            yield "gate", gate_id, way, t, lat, lon, sog
    state.last = [t, lat, lon]


def _seconds(column: str = "ts") -> Column:
    return F.unix_micros(column) / 1e6


ORDER = ("t", "lat", "lon", "sog")


def usable(fixes: DataFrame) -> DataFrame:
    """``mmsi, ts, t, lat, lon, sog, cog, is_tanker`` of the fixes with id, time and position."""
    course = F.col("cog").cast("double") if "cog" in fixes.columns else F.lit(None).cast("double")
    rows = fixes.select("mmsi", F.col("ts").cast("timestamp").alias("ts"), "lat", "lon", "sog", course.alias("cog"), F.col("is_tanker").alias("is_tanker"))
    return rows.dropna(subset=["mmsi", "ts", "lat", "lon"]).withColumn("t", _seconds())


def downsampled(fixes: DataFrame, every_s: int) -> DataFrame:
    """The first fix of each vessel in each ``every_s`` seconds, from its first fix as a tanker on."""
    order = Window.partitionBy("mmsi").orderBy(*ORDER)
    so_far = F.max(F.col("is_tanker").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    bucket = F.floor(F.col("t") / every_s)
    tankers = fixes.withColumn("tanker", so_far).where("tanker = 1").withColumn("bucket", bucket)
    return tankers.withColumn("before", F.lag("bucket").over(order)).where("before IS NULL OR before < bucket").drop("tanker", "bucket", "before")


def held_by(polygons: tuple[Polygon, ...], x: Column, y: Column) -> Column:
    """Numbers of the polygons that hold a point."""
    if not polygons:
        return F.array().cast("array<int>")
    sides = lambda points: [F.array(*[F.lit(float(p[k])) for p in points]) for k in (0, 1)]
    held = []
    for p in polygons:
        if p.buffer_m:
            place, ring = mercator(y, x), sides([metres(*q) for q in p.ring])
            held.append(in_ring(*place, *ring) | (ring_distance(*place, *ring) <= p.buffer_m))
        else:
            held.append(in_ring(x, y, *sides(p.ring)))
    return F.array_compact(F.array(*[F.when(h, F.lit(i)) for i, h in enumerate(held)]))


def observed(fixes: DataFrame, rules: Rules) -> DataFrame:
    """Down-sampled fixes with ``within``, ``ways`` and ``jump``; those that can't change a vessel's state are left out."""
    order = Window.partitionBy("mmsi").orderBy(*ORDER)
    rows = downsampled(usable(fixes), rules.downsample_s)
    rows = rows.withColumns({f"last_{c}": F.lag(c).over(order) for c in ("t", "lat", "lon")})
    hours = (F.col("t") - F.col("last_t")) / 3600
    jump = F.coalesce(F.try_divide(haversine("last_lat", "last_lon", "lat", "lon", EARTH_NM), hours) > rules.spoof_kn, F.lit(False))
    before, now = mercator("last_lat", "last_lon"), mercator("lat", "lon")
    ways = [_way(g, before, now, F.col("cog")) for g in rules.gates]
    crossed = F.array_compact(F.array(*[F.when(w.isNotNull(), F.concat(F.lit(f"{g.gate_id}|"), w)) for g, w in zip(rules.gates, ways)]))
    rows = rows.select(
        "mmsi", *ORDER, "last_lat", "last_lon", held_by(rules.polygons, F.col("lon"), F.col("lat")).alias("within"),
        (crossed if rules.gates else F.array().cast("array<string>")).alias("ways"), jump.alias("jump"),
    )
    telling = F.max((F.size("within") > 0).cast("int")).over(order.rowsBetween(-rules.hits, 0)) == 1
    return rows.withColumn("telling", telling | (F.size("ways") > 0) | F.col("jump")).where("telling").drop("telling")


def in_order(
    rows: DataFrame, columns: list[str], new: Callable[[], object], told: Callable, make: Callable[[list], pd.DataFrame], ddl: str, ended: Callable | None = None
) -> DataFrame:
    """``told(state, mmsi, *values)`` over each vessel's rows in order, with a state from ``new`` for each vessel, and ``ended(state, mmsi)`` after its last.

    The windows that ``rows`` come from have brought a vessel's rows together; the state goes on from batch to batch.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mmsi, state = None, None
        for frame in frames:
            found = []
            for own, *values in zip(*(frame[c].tolist() for c in ("mmsi", *columns))):
                if own != mmsi:
                    if ended and mmsi is not None:
                        found.extend(ended(state, mmsi))
                    mmsi, state = own, new()
                found.extend(told(state, own, *values))
            yield make(found)
        if ended and mmsi is not None:
            yield make(list(ended(state, mmsi)))

    return rows.sortWithinPartitions("mmsi", *ORDER).select("mmsi", *columns).mapInPandas(run, ddl)


def geofence_events(fixes: DataFrame, rules: Rules) -> DataFrame:
    """Events of a table of fixes (mmsi, ts, lat, lon, sog, is_tanker, maybe cog)."""
    names = [p.polygon_id for p in rules.polygons]

    def told(state, mmsi, t, lat, lon, sog, last_lat, last_lon, within, ways, jump):
        if state.last is not None:
            state.last[1:] = last_lat, last_lon
        crossed = [tuple(w.rsplit("|", 1)) for w in ways]
        for e in advance(state, rules, t, lat, lon, None if sog != sog else sog, {names[i] for i in within}, crossed, jump):
            yield mmsi, *e

    columns = [*ORDER, "last_lat", "last_lon", "within", "ways", "jump"]
    return in_order(observed(fixes, rules), columns, VesselState, told, _frame, EVENT_DDL)


def stay(sessions: dict[int, list], rules: Rules, t: float, lat: float, lon: float, sog: float | None, within: list[int]) -> Iterator[tuple]:
    """Stays (number of the polygon, seconds in and out, last place) that a fix ends; ``sessions`` has entry, last time and place of the open ones."""
    speed = 0.0 if sog is None or sog != sog else sog
    for i in list(sessions):
        if i in within:
            continue
        entered, last, last_lon, last_lat = sessions[i]
        if _nm(last_lat, last_lon, lat, lon) <= rules.stay_nm and speed < rules.stay_kn:
            sessions[i] = [entered, t, lon, lat]
            continue
        del sessions[i]
        yield i, entered, last if t - last > rules.silent_s else t, last_lon, last_lat
    for i in within:
        sessions[i] = [sessions[i][0] if i in sessions else t, t, lon, lat]


def dwell_row(rules: Rules, mmsi: int, i: int, entered: float, left: float, lon: float, lat: float) -> list[tuple]:
    """The row of a stay, if it was long enough for its polygon."""
    polygon, minutes = rules.polygons[i], int((left - entered) / 60)
    return [(mmsi, polygon.polygon_id, polygon.kind, entered, left, minutes, lon, lat)] if minutes >= polygon.min_dwell_min else []


def dwell_sessions(fixes: DataFrame, rules: Rules, close_at: dt.datetime | None = None) -> DataFrame:
    """Closed stays in polygons: every fix counts, a vessel may be in several polygons at once.

    A fix outside leaves a session open if the vessel is slow and near its last place inside. Otherwise the session
    ends there and then, or, after a longer silence, at the last time inside. Sessions shorter than the polygon's
    minimum are not told; those still open after a vessel's last fix end at ``close_at`` (UTC), or are not told without it.
    """
    order = Window.partitionBy("mmsi").orderBy(*ORDER)
    rows = usable(fixes).withColumn("within", held_by(rules.polygons, F.col("lon"), F.col("lat")))
    # a vessel that has not been in any polygon so far has no session
    rows = rows.withColumn("ever", F.max(F.size("within")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("ever > 0")
    end = close_at and close_at.replace(tzinfo=dt.timezone.utc).timestamp()

    def told(sessions: dict, mmsi, t, lat, lon, sog, within):
        for left in stay(sessions, rules, t, lat, lon, sog, list(within)):
            yield from dwell_row(rules, mmsi, *left)

    def ended(sessions: dict, mmsi):
        for i, (entered, _, lon, lat) in sessions.items():
            yield from dwell_row(rules, mmsi, i, entered, end, lon, lat)

    return in_order(rows, [*ORDER, "within"], dict, told, _timed(DWELL_DDL, "ts_in", "ts_out"), DWELL_DDL, ended if close_at else None)


class Track:
    """A vessel's fixes of the last while (seconds, speed, course), and where its last tracklet ended."""

    def __init__(self, fixes=(), told: float | None = None):
        self.fixes, self.told = deque(fixes), told

    def piece(self, rules: Rules, mmsi: int, t: float, sog: float | None, cog: float | None) -> list[tuple]:
        """The tracklet that a fix ends, if it does."""
        least, most = rules.tracklet_s
        self.fixes.append((t, 0.0 if sog is None or sog != sog else sog, 0.0 if cog is None or cog != cog else math.radians(cog)))
        while t - self.fixes[0][0] > most:
            self.fixes.popleft()
        start, n = self.fixes[0][0], len(self.fixes)
        if n < 2 or t - start < least or (self.told is not None and start <= self.told):
            return []
        self.told = t
        course = math.degrees(math.atan2(sum(math.sin(c) for _, _, c in self.fixes), sum(math.cos(c) for _, _, c in self.fixes)))
        return [(f"{mmsi}-{int(t)}", mmsi, start, t, n, (course + 360.0) % 360.0, sum(s for _, s, _ in self.fixes) / n)]


def tracklets(fixes: DataFrame, rules: Rules) -> DataFrame:
    """Pieces of track that do not overlap: told once the fixes of the longest span, all after the last piece, cover the shortest.

    Missing courses count as north and missing speeds as 0.
    """

    def told(track: Track, mmsi, t, lat, lon, sog, cog):
        return track.piece(rules, mmsi, t, sog, cog)

    rows = downsampled(usable(fixes), rules.downsample_s)
    return in_order(rows, [*ORDER, "cog"], Track, told, _timed(TRACKLET_DDL, "start_ts", "end_ts"), TRACKLET_DDL)


@dataclass
class Visit:
    """What a vessel's presence at one polygon has come to: fixes in a row, whether it is in, times, and speeds since the last exit."""

    hits: int = 0
    misses: int = 0
    inside: bool = False
    enter: float | None = None
    exit: float | None = None
    seen: float | None = None
    n: int = 0
    low: float | None = None
    high: float | None = None
    total: float = 0.0
    speeds: int = 0

    def row(self, mmsi: int, polygon_id: str) -> tuple:
        return mmsi, polygon_id, self.enter, self.exit, self.seen, self.inside, self.n, self.low, self.high, self.total / self.speeds if self.speeds else None

    def fix(self, rules: Rules, mmsi: int, polygon: Polygon, t: float, sog: float | None, within: bool) -> Iterator[tuple]:
        """Presence rows of one fix: after each one inside, at the exit, and before it where the vessel was silent for too long."""
        if self.inside and t - self.seen > (rules.anchorage_ttl_s if polygon.anchorage else rules.ttl_s):
            yield from self.leave(self.seen, mmsi, polygon)
            self.hits = self.misses = 0
        self.hits, self.misses, self.seen = (self.hits + 1, 0, t) if within else (0, self.misses + 1, t)
        if within:
            self.n += 1
            if sog is not None and sog == sog:
                self.low, self.high = min(sog, self.low if self.low is not None else sog), max(sog, self.high if self.high is not None else sog)
                self.total, self.speeds = self.total + sog, self.speeds + 1
            if not self.inside and self.hits >= rules.hits:
                self.inside, self.enter = True, t
            yield self.row(mmsi, polygon.polygon_id)
        elif self.inside and self.misses >= rules.hits:
            yield from self.leave(t, mmsi, polygon)

    def leave(self, t: float, mmsi: int, polygon: Polygon) -> Iterator[tuple]:
        self.inside, self.exit = False, t
        yield self.row(mmsi, polygon.polygon_id)
        self.enter, self.n, self.low, self.high, self.total, self.speeds = None, 0, None, None, 0.0, 0


def presence_of(visits: dict[int, Visit], rules: Rules, mmsi: int, t: float, sog: float | None, within: list[int]) -> Iterator[tuple]:
    """Presence rows of one fix for all polygons that the vessel has been in."""
    for i in within:
        visits.setdefault(i, Visit())
    for i, visit in sorted(visits.items()):
        yield from visit.fix(rules, mmsi, rules.polygons[i], t, sog, i in within)


def presence_upserts(fixes: DataFrame, rules: Rules) -> DataFrame:
    """Rows to merge into a table keyed by vessel and polygon, with ``nth``, their number for the vessel: one after each fix inside, one at each exit."""
    order = Window.partitionBy("mmsi").orderBy(*ORDER)
    rows = downsampled(usable(fixes), rules.downsample_s).withColumn("within", held_by(rules.polygons, F.col("lon"), F.col("lat")))
    rows = rows.withColumn("ever", F.max(F.size("within")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("ever > 0")

    def told(state: list, mmsi, t, lat, lon, sog, within):
        for row in presence_of(state[1], rules, mmsi, t, sog, list(within)):
            state[0] += 1
            yield *row, state[0]

    ddl = f"{PRESENCE_DDL}, nth long"
    return in_order(rows, [*ORDER, "within"], lambda: [0, {}], told, _timed(ddl, "enter_ts", "exit_ts", "last_seen_ts"), ddl)


def presence(fixes: DataFrame, rules: Rules) -> DataFrame:
    """The keyed table that the rows of ``presence_upserts`` leave."""
    upserts = presence_upserts(fixes, rules)
    rest = [c for c in upserts.columns if c not in ("mmsi", "polygon_id", "nth")]
    last = upserts.groupBy("mmsi", "polygon_id").agg(F.max_by(F.struct(*rest), "nth").alias("_r"))
    return last.select("mmsi", "polygon_id", "_r.*")


def _nm(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    return knots(3600.0, lat1, lon1, lat2, lon2)


def _timed(ddl: str, *times: str) -> Callable[[list], pd.DataFrame]:
    """Makes frames of rows whose ``times`` are seconds."""
    kinds = dict(part.split() for part in ddl.split(", "))

    def make(found: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(found, columns=list(kinds))
        for c in times:
            micros = (out[c].astype("float64") * 1e6).round().astype("Int64")
            out[c] = pd.to_datetime(micros, unit="us")
        return out.astype({c: "float64" for c, kind in kinds.items() if kind == "double"})

    return make


def _frame(found: list[tuple]) -> pd.DataFrame:
    return _timed(EVENT_DDL, "ts")(found)


def step(state: VesselState, rules: Rules, fix) -> Iterator[tuple]:
    """Events of one fix of a stream, for which nothing is worked out beforehand."""
    state.tanker = state.tanker or bool(fix.is_tanker)
    bucket = int(fix.t // rules.downsample_s)
    if not state.tanker or bucket <= state.last_bucket:
        return  # not a tanker, a second fix of its bucket, or out of order
    state.last_bucket = bucket
    within = {p.polygon_id for p in rules.polygons if holds(p, fix.lon, fix.lat)}
    ways, jump = [], False
    if state.last is not None:
        t, lat, lon = state.last
        jump = knots(fix.t - t, lat, lon, fix.lat, fix.lon) > rules.spoof_kn
        for gate in rules.gates:
            if way := crossing(gate, (lon, lat), (fix.lon, fix.lat), fix.cog):
                ways.append((gate.gate_id, way))
    yield from advance(state, rules, fix.t, fix.lat, fix.lon, fix.sog, within, ways, jump)


def crossing(gate: Gate, before: tuple[float, float], now: tuple[float, float], course: float | None) -> str | None:
    """As ``_way``, of places in degrees."""
    a, b, normal = _ends_and_normal(gate)
    p, q = metres(*before), metres(*now)
    if not (_side(a, b, p) * _side(a, b, q) <= 0 and _side(p, q, a) * _side(p, q, b) <= 0):
        low, high = (0.0, 1.0) if gate.buffer_m and any(normal) else (1.0, 0.0)
        for start, move, least, most in _in_gate(gate, p, q) if low < high else ():
            one, two = ((least - start) / move, (most - start) / move) if move else (0.0, 1.0) if least <= start <= most else (2.0, 2.0)
            low, high = max(low, min(one, two)), min(high, max(one, two))
        if low > high:
            return None
    dx, dy = q[0] - p[0], q[1] - p[1]
    if not math.hypot(dx, dy):
        if course is None or course != course:
            return None
        dx, dy = math.cos(math.radians(course)), math.sin(math.radians(course))
    return "AtoB" if dx * normal[0] + dy * normal[1] >= 0 else "BtoA"


def geofence_stream(fixes: DataFrame, rules: Rules, late: str = "10 minutes") -> DataFrame:
    """The same on a stream; state is the vessel's, and expires when the watermark passes its longest time to live."""
    longest_ms = 1000 * max(rules.ttl_s, rules.anchorage_ttl_s)

    def run(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state = VesselState.load(kept.get[0]) if kept.exists else VesselState()
        if kept.hasTimedOut:
            if state.last is not None:
                now = state.last[0] + longest_ms / 1000 + 1
                yield _frame([(key[0], *e) for e in expire(state, rules, now)])
            kept.remove()
            return
        rows = pd.concat(list(batches)).sort_values(list(ORDER))
        yield _frame([(key[0], *e) for fix in rows.itertuples() for e in step(state, rules, fix)])
        kept.update((state.dump(),))
        seen_ms = int((state.last[0] if state.last else rows["t"].max()) * 1000)
        kept.setTimeoutTimestamp(max(seen_ms + longest_ms, kept.getCurrentWatermarkMs() + 1))

    watched = usable(fixes).withWatermark("ts", late)
    return watched.groupBy("mmsi").applyInPandasWithState(run, EVENT_DDL, STATE_DDL, "append", GroupStateTimeout.EventTimeTimeout)
