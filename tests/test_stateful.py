"""Streams with state beside their batch twins, open stays, presence and polygons with a buffer."""

import datetime as dt
import random

import pytest

from tideline.streaming import geofence, stateful, windows

DDL = "mmsi long, ts timestamp, lat double, lon double, sog double, cog double, is_tanker boolean"
START = dt.datetime(2024, 3, 1)
SQUARE = ((0.0, 0.0), (0.1, 0.0), (0.1, 0.1), (0.0, 0.1))
RULES = geofence.Rules(
    polygons=(
        geofence.Polygon("A", SQUARE, anchorage=True, min_dwell_min=10),
        geofence.Polygon("B", tuple((x + 0.08, y) for x, y in SQUARE), kind="sts", min_dwell_min=0, buffer_m=150.0),
    ),
    ttl_s=20 * 60,
    anchorage_ttl_s=40 * 60,
)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def walk():
    """Vessels that wander in and out of two polygons, with silences and missing speeds; far ahead, one that moves the watermark on."""
    rng, rows = random.Random(6), []
    for mmsi in range(1, 7):
        t, lat, lon = 0.0, rng.uniform(0, 0.1), rng.uniform(0, 0.2)
        for _ in range(70):
            t += rng.choice([0.4, 2, 3, 5, 5, 8, 50])
            lat, lon = lat + rng.gauss(0, 0.02) * (rng.random() < 0.6), lon + rng.gauss(0, 0.02) * (rng.random() < 0.6)
            rows.append((mmsi, at(t), lat, lon, rng.choice([0.0, 0.5, 3.0, 12.5, None]), rng.choice([None, 10.0, 350.0, 200.0]), mmsi != 3 or t > 100))
    return rows


def streamed(spark, tmp_path, rows, make, name, **how):
    """The stream's output over five files, each with fixes out of order across files by up to half an hour."""
    rows = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=random.Random(str(r)).uniform(0, 30)))
    size = -(-len(rows) // 5)
    last = (999, max(r[1] for r in rows) + dt.timedelta(days=2), 50.0, 50.0, 1.0, 1.0, True)
    parts = [rows[i : i + size] for i in range(0, len(rows), size)] + [[last], [(998, last[1] + dt.timedelta(days=1), *last[2:])]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, DDL).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    writer = make(source, RULES, "40 minutes").writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True)
    query = (writer.foreachBatch(how["sink"]) if "sink" in how else writer.format("memory").queryName(name)).start()
    assert query.awaitTermination(240)
    return None if "sink" in how else spark.table(name)


def rows_of(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect() if r.mmsi < 900), key=repr)


@pytest.mark.parametrize("batch, stream", [(geofence.dwell_sessions, stateful.dwell_session_stream), (geofence.tracklets, stateful.tracklet_stream), (geofence.presence_upserts, stateful.presence_stream)])
def test_stream_gives_what_the_batch_gives(spark, tmp_path, batch, stream):
    rows = walk()
    want = rows_of(batch(spark.createDataFrame(rows, DDL), RULES))
    assert len(want) > 10
    assert rows_of(streamed(spark, tmp_path, rows, stream, stream.__name__)) == want


def test_presence_into_a_keyed_table(spark, tmp_path):
    rows = walk()
    sink = windows.upsert_sink(f"{tmp_path}/table", ["mmsi", "polygon_id"], "nth", buckets=4)
    streamed(spark, tmp_path, rows, stateful.presence_stream, "unused", sink=sink)
    assert rows_of(windows.read_upserted(spark, f"{tmp_path}/table").drop("nth")) == rows_of(geofence.presence(spark.createDataFrame(rows, DDL), RULES))


def test_presence_by_hand(spark):
    """In with the second fix, speeds of all fixes since the exit before, out with the second miss; a silence ends a visit at the last time seen."""
    fixes = [(0, 0.05, 4.0), (2, 0.05, 2.0), (4, 0.05, None), (6, 0.5, 9.0), (8, 0.5, 9.0), (10, 0.05, 1.0)]
    rows = [(1, at(m), 0.05, lon, sog, None, True) for m, lon, sog in fixes]
    got = {r.polygon_id: tuple(r)[2:] for r in geofence.presence(spark.createDataFrame(rows[:5], DDL), RULES).collect()}
    assert got == {"A": (at(2), at(8), at(8), False, 3, 2.0, 4.0, 3.0)}
    got = geofence.presence(spark.createDataFrame(rows, DDL), RULES).first()
    assert tuple(got)[2:] == (None, at(8), at(10), False, 1, 1.0, 1.0, 1.0)
    silent = [*rows[:3], (1, at(120), 0.05, 0.05, 6.0, None, True)]
    told = [tuple(r)[2:6] for r in geofence.presence_upserts(spark.createDataFrame(silent, DDL), RULES).orderBy("nth").collect()]
    assert told[-2:] == [(at(2), at(4), at(4), False), (None, at(4), at(120), False)]


def test_a_fix_near_a_buffered_ring_is_inside(spark):
    """100 m and 200 m east of B's eastern edge, and the same north of A, which has no buffer."""
    east = lambda m: 0.18 + m / 111319.49
    rows = [(v, at(2 * k), lat, lon, 1.0, None, True) for v, lat, lon in ((1, 0.05, east(100)), (2, 0.05, east(200)), (3, 0.1 + 100 / 111319.49, 0.02)) for k in range(3)]
    found = geofence.geofence_events(spark.createDataFrame(rows, DDL), RULES).collect()
    assert [(r.mmsi, r.place_id, r.event) for r in found] == [(1, "B", "enter")]
    assert [geofence.holds(RULES.polygons[1], east(m), 0.05) for m in (-5, 100, 149, 151)] == [True, True, True, False]


def test_open_stays_end_when_told(spark):
    rows = [(1, at(m), 0.05, 0.02, 0.1, None, True) for m in (0, 5, 12)] + [(2, at(0), 0.05, 0.02, 0.1, None, True), (2, at(30), 3.0, 3.0, 9.0, None, True)]
    df = spark.createDataFrame(rows, DDL)
    assert [(r.mmsi, r.dwell_min) for r in geofence.dwell_sessions(df, RULES).collect()] == []
    told = geofence.dwell_sessions(df, RULES, close_at=at(45)).collect()
    assert [(r.mmsi, r.polygon_id, r.ts_in, r.ts_out, r.dwell_min) for r in told] == [(1, "A", at(0), at(45), 45)]
    assert geofence.dwell_sessions(df, RULES, close_at=at(9)).count() == 0
