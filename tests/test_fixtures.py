"""Golden cases: hand-made inputs with known results."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import daily, detect, flux, geo, models, registry, seasonal, shapes, transit
from tideline.sources import ais, ports, readers
from tideline.streaming import geofence, windows

T = dt.datetime(2024, 1, 10, 12)


def hours(n):
    return T + dt.timedelta(hours=n)


def test_corridor_transits_and_rolling_flux(spark):
    rows = [
        (111, "N", hours(-6), "AtoB"), (111, "S", hours(8), "AtoB"), (222, "N", hours(-8), "AtoB"), (222, "S", hours(10), "AtoB"),
    ]
    crossings = spark.createDataFrame(rows, "mmsi long, gate_id string, ts timestamp, direction string")
    rolled = {(r.window_label, r.gate_id): r.crossings for r in flux.rolling_flux(crossings, F.lit(T)).collect()}
    assert rolled[("24h", "N")] == 2 and rolled[("7d", "N")] == 2
    found = transit.next_match(crossings, F.col("gate_id") == "N", F.col("gate_id") == "S")
    stats = transit.transit_stats(found.withColumn("ds", F.to_date("entry_ts")), ["ds"]).first()
    assert (stats.n, stats.median_h, stats.mean_h) == (2, 16.0, 16.0) and stats.p90_h >= 16


def test_next_match_is_strictly_later(spark):
    rows = [(1, "N", hours(0)), (1, "S", hours(0)), (1, "S", hours(3))]
    crossings = spark.createDataFrame(rows, "mmsi long, gate_id string, ts timestamp")
    found = transit.next_match(crossings, F.col("gate_id") == "N", F.col("gate_id") == "S").collect()
    assert [r.hours for r in found] == [3.0]


def test_transit_anomaly(spark):
    rows = []
    for mmsi, start, took in ((1, -85, 12), (2, -62, 13), (3, -26, 25)):
        rows += [(mmsi, "exit AG", hours(start)), (mmsi, "enter HORMUZ", hours(start + took))]
    events = spark.createDataFrame(rows, "mmsi long, event string, ts timestamp")
    pairs = transit.lead_pairs(events)
    assert [r.mmsi for r in transit.transit_anomalies(pairs, ["event", "to_event"], F.lit(hours(-48))).collect()] == [3]


def test_floating_storage(spark):
    visits = spark.createDataFrame([("P", 48.0), ("P", 28.0)], "polygon_id string, h double")
    row = detect.long_stays(visits, F.col("h")).first()
    assert (row.count_vlcc, row.count_other) == (1, 2)


def test_route_deviation(spark):
    day = dt.date(2024, 1, 15)
    rows = [(day - dt.timedelta(d), "CAPE", 20) for d in (0, 1, 2)] + [(day - dt.timedelta(d), "SUEZ", 10) for d in (0, 1, 2)]
    rows += [(day - dt.timedelta(d), g, n) for d in (13, 14) for g, n in (("CAPE", 5), ("SUEZ", 25))]
    daily = spark.createDataFrame(rows, "ds date, gate_id string, crossings int")
    shares = flux.route_share(daily, "CAPE", "SUEZ", F.lit(day))
    found = detect.route_deviation(shares).first()
    assert round(found.recent_share, 3) == 0.667 and round(found.baseline_share, 3) == 0.167


def test_strait_proxy(spark):
    rows = [
        ("2024-10-10 00:00:00", "bosporus", 6), ("2024-10-10 00:10:00", "bosporus", 2), ("2024-10-10 00:20:00", "bosporus", 7),
        ("2024-10-11 00:00:00", "bosporus", 1), ("2024-10-11 00:10:00", "bosporus", 5), ("2024-10-11 00:20:00", "other", 9),
    ]
    dwell = spark.createDataFrame(rows, "t string, region string, slow_count long").withColumn("window_start", F.col("t").cast("timestamp"))
    out = [tuple(r)[1:] for r in ports.strait_proxy(dwell, "bosporus", factor=1.0).orderBy("ts").collect()]
    assert out == [(20, 5.0), (10, 3.0)]


def test_canonical_messages(spark):
    def message(lat, sog, kind):
        return f'{{"MMSI": 123456789, "MetaData": {{"receivedTimestamp": 1700000000000}}, "Message": {{"PositionReport": {{"Latitude": {lat}, "Longitude": 10, "Sog": {sog}, "Cog": 400, "ShipType": {kind}}}}}}}'

    rows = [(message(1.5, 3, 82), T), (message(1.5, 0, '"General Cargo"'), T), (message(95, 3, 82), T), (message(1.5, 55, 82), T)]
    out = ais.canonicalize(spark.createDataFrame(rows, "payload string, rx_time timestamp")).orderBy("sog").collect()
    assert [(r.sog, r.is_tanker, r.cog) for r in out] == [(0.0, False, None), (3.0, True, None)]
    assert out[0].msg_time == dt.datetime(2023, 11, 14, 22, 13, 20)


def test_port_stays(spark):
    ddl = "ship_type string, port_name string, berth_in string, berth_out string, atd string, etd string, ata string, stay_start string"
    rows = [
        ("Crude Tanker", "Antwerp", None, None, "2025-01-10T01:00:00", None, None, None),
        ("crude oil", None, "BEANR1", "BEANR2", "2025-01-10T05:00:00", None, "2025-01-08T05:00:00", None),
        ("LNG tanker", "Zeebrugge", None, None, None, None, "2025-01-09T05:00:00", None),
        ("bulk", "Antwerp", None, None, "2025-01-10T01:00:00", None, None, None),
    ]
    out = {(r.port_code, str(r.ds)): (r.departures, r.arrivals) for r in ports.stay_summary(spark.createDataFrame(rows, ddl)).collect()}
    assert out == {("antwerp", "2025-01-10"): (2, 0), ("antwerp", "2025-01-08"): (0, 1), ("zeebrugge", "2025-01-09"): (0, 1)}


def test_upsert_replaces_and_adds(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    delta = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, registry.upsert(base, delta, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


RING = ((-0.01, 0.0), (0.01, 0.0), (0.01, 0.02), (-0.01, 0.02))
RULES = geofence.Rules(
    polygons=(geofence.Polygon("TEST_POLY", RING, anchorage=True),), gates=(geofence.Gate("TEST_GATE", (0.015, -0.05), (0.015, 0.05)),), spoof_kn=1e9
)
FIX_DDL = "mmsi long, ts timestamp, lat double, lon double, sog double, is_tanker boolean"


def fixes():
    start = dt.datetime(2024, 1, 1)
    path = [(0.010, 0.000), (0.011, 0.001), (0.005, 0.030), (0.004, 0.040)]
    return [(123456789, start + dt.timedelta(minutes=i), lat, lon, 1.0, True) for i, (lat, lon) in enumerate(path)]


WANT = [("polygon", "enter", 1), ("gate", "BtoA", 2), ("polygon", "exit", 3)]


def told(rows):
    start = dt.datetime(2024, 1, 1)
    return [(r.kind, r.event, int((r.ts - start).total_seconds() // 60)) for r in sorted(rows, key=lambda r: r.ts)]


def test_geofence_batch(spark):
    assert told(geofence.geofence_events(spark.createDataFrame(fixes(), FIX_DDL), RULES).collect()) == WANT


def test_geofence_other_vessels_are_ignored(spark):
    rows = [(*r[:5], False) for r in fixes()]
    assert geofence.geofence_events(spark.createDataFrame(rows, FIX_DDL), RULES).count() == 0


def test_geofence_stream_agrees_with_batch(spark, tmp_path):
    rows = fixes()
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, FIX_DDL).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(FIX_DDL).parquet(f"{tmp_path}/in")
        query = (
            geofence.geofence_stream(stream, RULES).writeStream.format("parquet").option("path", f"{tmp_path}/out")
            .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        )
        assert query.awaitTermination(120)
    assert told(spark.read.parquet(f"{tmp_path}/out").collect()) == WANT


def test_dwell_stream_agrees_with_batch(spark, tmp_path):
    rows = [(i % 7, T + dt.timedelta(minutes=i), "r", float(i % 3)) for i in range(60)]
    ddl = "mmsi long, msg_time timestamp, region string, sog double"
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = windows.dwell_stream(spark.readStream.schema(ddl).parquet(f"{tmp_path}/in"), F.col("sog") < 1)
    query = stream.writeStream.format("memory").queryName("dwell_out").outputMode("complete").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = {r.window_start: r.slow_count for r in spark.table("dwell_out").collect()}
    slow = [r for r in rows if r[3] < 1]
    want = {}
    for mmsi, t, _, _ in slow:
        want.setdefault(t.replace(minute=t.minute // 10 * 10), set()).add(mmsi)
    assert got == {k: len(v) for k, v in want.items()}


def test_upsert_sink_keeps_newest(spark, tmp_path):
    write = windows.upsert_sink(str(tmp_path), ["k"], "t", buckets=4)
    ddl = "k int, t int, v string"
    write(spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (2, 0, "old")], ddl), 0)
    write(spark.createDataFrame([(2, 2, "c"), (3, 2, "d")], ddl), 1)
    for _ in range(2):  # a batch that is written again
        write(spark.createDataFrame([(2, 3, "e")], ddl), 5)
    got = windows.read_upserted(spark, str(tmp_path), buckets=4)
    assert sorted((r.k, r.v) for r in got.collect()) == [(1, "a"), (2, "e"), (3, "d")]


def test_upsert_sink_keeps_newer_rows_from_late_batches(spark, tmp_path):
    write = windows.upsert_sink(str(tmp_path), ["k"], "t", buckets=2)
    ddl = "k int, t int, v string"
    for number, rows in enumerate([[(1, 5, "new"), (2, 1, "a")], [(1, 2, "late"), (3, 1, "b")], [(1, 4, "late")], [(2, 2, "c")]]):
        write(spark.createDataFrame(rows, ddl), number)
    assert sorted((r.k, r.t, r.v) for r in windows.read_upserted(spark, str(tmp_path)).collect()) == [(1, 5, "new"), (2, 2, "c"), (3, 1, "b")]
    kept = [p for p in tmp_path.glob("*/_b=*")]
    assert len(kept) <= 4


def test_holt_by_hand(spark):
    """Levels 10, 13, 14.63 and trends 0, 0.9, 1.119 at 0.3; one-step errors 10 and 2.1."""
    rows = spark.createDataFrame([("s", 1, 10.0), ("s", 2, 20.0), ("s", 3, 16.0), ("one", 1, 4.0)], "k string, d int, x double")
    got = {(r.k, r.h): r for r in seasonal.holt(rows, ["k"], horizon=2).collect()}
    level = 0.3 * 16 + 0.7 * 13.9
    trend = 0.3 * (level - 13) + 0.7 * 0.9
    sigma = (10.0 - 2.1) / 2
    assert got["s", 2].forecast == pytest.approx(level + 2 * trend) and got["s", 2].high == pytest.approx(level + 2 * trend + 1.96 * sigma * 2**0.5)
    assert (got["one", 1].forecast, got["one", 1].low, got["one", 1].high) == (4.0, 4.0, 4.0)


def test_formulas_by_hand(spark):
    """Modified z scores, the bands of seasonal z scores, and head components, worked out on paper."""
    rows = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)], "k string, x double")
    point = detect.point_anomalies(rows, ["k"], "x").where("x = 100").first()
    assert point.z == pytest.approx(0.6745 * 97)
    bands = spark.createDataFrame([(-2.6,), (-1.0,), (0.0,), (0.5,), (1.5,), (2.5,)], "z double").select(seasonal.band_of(F.col("z"))).collect()
    assert [b[0] for b in bands] == ["far below", "below", "normal", "above", "well above", "far above"]


def test_gate_buffer_and_course(spark):
    """A move that stops short of a gate counts within its buffer only; a vessel at rest on it goes by its course."""
    start = dt.datetime(2024, 1, 1)
    rows = [(1, start, 0.0, 0.010, 9.0, 90.0, True), (1, start + dt.timedelta(minutes=1), 0.0, 0.0145, 9.0, 90.0, True)]
    rows += [(2, start, 0.0, 0.015, 0.0, 180.0, True), (2, start + dt.timedelta(minutes=1), 0.0, 0.015, 0.0, 180.0, True)]
    fixes = spark.createDataFrame(rows, "mmsi long, ts timestamp, lat double, lon double, sog double, cog double, is_tanker boolean")
    for buffer, want in ((0.0, [(2, "AtoB")]), (100.0, [(1, "BtoA"), (2, "AtoB")])):
        gate = geofence.Gate("G", (0.015, -0.05), (0.015, 0.05), buffer)
        got = geofence.geofence_events(fixes, geofence.Rules(gates=(gate,), spoof_kn=1e9)).collect()
        assert sorted((r.mmsi, r.event) for r in got) == want
        places = [((r[3], r[2]), (s[3], s[2]), s[5]) for r, s in (rows[:2], rows[2:])]
        assert [geofence.crossing(gate, *p) for p in places] == [dict(want).get(1), "AtoB"]


def test_readers(spark, tmp_path):
    spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string").createOrReplaceTempView("pairs")
    readers.export_csv(spark.table("pairs"), f"{tmp_path}/t.csv", ["k"])
    assert sorted(map(tuple, readers.read_table(spark, f"{tmp_path}/t.csv").collect())) == [(1, "a"), (2, "b")]
    (tmp_path / "x.jsonl").write_text('{"k": 1}\n{"k": 2}\n')
    assert readers.read_table(spark, f"{tmp_path}/x.jsonl", "k long").agg(F.sum("k")).first()[0] == 3
    (tmp_path / "g.json").write_text(
        '{"type": "FeatureCollection", "features": ['
        '{"type": "Feature", "properties": {"id": "P"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 1], [0, 0]]]}},'
        '{"type": "Feature", "properties": {"id": "L"}, "geometry": {"type": "LineString", "coordinates": [[5, 6], [7, 8]]}}]}'
    )
    got = {r.feature_id: (r.kind, r.xs, r.ys) for r in readers.read_geojson(spark, f"{tmp_path}/g.json").collect()}
    assert got == {"P": ("Polygon", [0.0, 2.0, 2.0], [0.0, 0.0, 1.0]), "L": ("LineString", [5.0, 7.0], [6.0, 8.0])}
    readers.replace_partitions(spark.createDataFrame([("a", 1), ("b", 2)], "kind string, n int"), f"{tmp_path}/alerts", ["kind"])
    readers.replace_partitions(spark.createDataFrame([("b", 3)], "kind string, n int"), f"{tmp_path}/alerts", ["kind"])
    assert sorted((r.kind, r.n) for r in spark.read.parquet(f"{tmp_path}/alerts").collect()) == [("a", 1), ("b", 3)]


def test_messages_from_a_stream(spark, tmp_path):
    """Lines dropped in a folder, through the stream source and the normalisation."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text('{"MMSI": 123456789, "lat": 1.5, "lon": 2.5, "sog": 3, "timestamp": 1704067200}\nnot json\n')
    stream = ais.canonicalize(readers.message_stream(spark, f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("messages_out").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert [(r.mmsi, r.lat, r.sog, str(r.msg_time)) for r in spark.table("messages_out").collect()] == [(123456789, 1.5, 3.0, "2024-01-01 00:00:00")]


def test_damping_and_drift(spark):
    rows = spark.createDataFrame([(None, 0.5), (0.5, 0.52), (0.5, 0.7)], "a double, b double")
    assert [r[0] for r in rows.select(models.damped(F.col("a"), F.col("b"))).collect()] == [0.5, 0.5, 0.7]
    base = spark.range(1, 101).select((F.col("id") / 100.0).alias("x"))
    assert models.ks(base, base, "x").first().ks == 0
    assert models.ks(base, base.select((F.col("x") + 0.05).alias("x")), "x").first().ks == pytest.approx(0.05, abs=0.011)
    edges = [i / 10 for i in range(11)]
    even = spark.range(100).select((0.1 + F.col("id") * 0.8 / 99).alias("x"))
    later = even.select((F.col("x") + 0.05).alias("x"))
    counts = lambda df: np.histogram([r.x for r in df.collect()], edges)[0] / 100
    p, q = counts(even), counts(later)
    want = sum((b - a) * math.log(max(b / max(a, 1e-6), 1e-6)) for a, b in zip(p, q))
    assert models.psi(even, even, "x", edges).first().psi == pytest.approx(0) and models.psi(even, later, "x", edges).first().psi == pytest.approx(want)
    # values outside the bins are no part of the shares; a sample without rows gives no index
    assert models.psi(even, later.union(spark.createDataFrame([(7.0,), (None,)], "x double")), "x", edges).first().psi == pytest.approx(want)
    assert models.psi(even, even.limit(0), "x", edges).first().psi is None


def test_momentum_within_bounds(spark):
    def series(name, values):
        return [(name, dt.date(2024, 1, 1) + dt.timedelta(i), float(v)) for i, v in enumerate(values)]

    wobble = [100 + i + (1 if i % 2 else -1) for i in range(40)]
    rows = [*series("up", wobble), *series("down", wobble[::-1]), *series("short", wobble[:21]), *series("wild", [100 * (1.5 if i % 2 else 1) for i in range(40)]), *series("flat", [5] * 30)]
    got = {r.k: r for r in daily.momentum_probability(spark.createDataFrame(rows, "k string, d date, x double"), ["k"], "d", "x", most_volatile=0.2).collect()}
    r7, r21 = (wobble[-1] - wobble[-7]) / wobble[-7], (wobble[-1] - wobble[-21]) / wobble[-21]
    moves = [b / a - 1 for a, b in zip(wobble, wobble[1:])]
    vols = [np.std(moves[i : i + 21], ddof=1) for i in range(len(moves) - 20)]
    vol = min(max(vols[-1], np.quantile(vols, 0.01)), np.quantile(vols, 0.99))
    assert (got["up"].r7, got["up"].r21, got["up"].vol21) == pytest.approx((r7, r21, vol))
    assert got["up"].p == pytest.approx(min(max(0.5 + 0.5 * math.tanh(3 * (r7 - r21 / 2) / vol), 0.35), 0.65)) and got["up"].reason is None
    assert 0.35 <= got["down"].p <= 0.65 and got["flat"].p == 0.5
    assert [(got[k].p, got[k].reason) for k in ("short", "wild")] == [(0.5, "insufficient_history"), (0.5, "high_volatility")]


def test_proxy_component_cuts_scores(spark):
    """Four years of one region: the score by day of year, then its percentiles; worked out with numpy."""
    rng, rows, want = np.random.default_rng(3), [], {}
    for year in (2021, 2022, 2023, 2025):
        for day in range(20):
            at, n = dt.datetime(year, 3, 1) + dt.timedelta(day), int(rng.integers(1, 50))
            rows += [(at, "r", n), (at + dt.timedelta(minutes=10), "r", 1), (at, "other", 99)]
            want[at.date()] = n + 1.0
    by_doy = {}
    for d, x in want.items():
        by_doy.setdefault(d.timetuple().tm_yday, []).append(x)
    z = {d: (x - np.mean(v)) / np.std(v, ddof=1) if np.std(v, ddof=1) else 0.0 for d, x in want.items() for v in [by_doy[d.timetuple().tm_yday]]}
    low, high = np.quantile(list(z.values()), [0.01, 0.99])
    got = {r.d: (r.x, r.z) for r in daily.proxy_component(spark.createDataFrame(rows, "window_start timestamp, region string, slow_count long"), "r").collect()}
    assert got == {d: (want[d], pytest.approx(min(max(z[d], low), high))) for d in want} and min(z.values()) < low


def test_health_stream_counts_silent_buckets(spark, tmp_path):
    minute = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [(1, minute(0), True, False), (2, minute(0), False, True), (1, minute(3), True, False), (1, minute(12), True, False), (1, minute(59), False, False)]
    ddl = "mmsi long, msg_time timestamp, is_tanker boolean, spoof boolean"
    df = spark.createDataFrame(rows, ddl)
    batch = {r.window_start: tuple(r)[1:] for r in daily.health_windows(df).collect()}
    assert batch[minute(0)] == (3, 2, pytest.approx(2 / 3), pytest.approx(0.8), pytest.approx(1 / 3)) and batch[minute(10)] == (1, 1, 1.0, 0.9, 0.0)
    df.write.parquet(f"{tmp_path}/in")
    stream = windows.health_stream(spark.readStream.schema(ddl).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("health_out").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert {(r.window_start, r.messages, r.gap_ratio) for r in spark.table("health_out").collect()} == {(minute(0), 3, 0.8), (minute(10), 1, 0.9)}


def test_gate_strip_ends_flat():
    """A gate of 0.1 degrees with a strip of 500 m on either side: beyond its ends nothing crosses, not even close by."""
    gate = geofence.Gate("g", (0.0, 0.0), (0.1, 0.0), 500.0)
    east = lambda m: math.degrees(m / 6378137.0)
    beyond, within = 0.1 + east(300), 0.1 - east(300)
    assert geofence.crossing(gate, (beyond, -0.01), (beyond, 0.01), None) is None
    assert geofence.crossing(gate, (within, -0.01), (within, 0.01), None) == "AtoB"
    # a move that stays on one side, 400 m off, is within the strip; 600 m off it isn't
    assert geofence.crossing(gate, (0.02, east(400)), (0.05, east(400)), 90.0) is not None
    assert geofence.crossing(gate, (0.02, east(600)), (0.05, east(600)), 90.0) is None
    assert geofence.crossing(gate, (beyond, east(10)), (beyond, east(10)), 0.0) is None


def test_direction_model(spark):
    rows = spark.range(240).select(
        F.expr("date_add(DATE '2024-01-01', CAST(id AS INT))").alias("d"), F.sin(F.col("id") * 0.9).alias("a"), F.cos(F.col("id") * 1.7).alias("b")
    ).withColumn("target", (F.col("a") + 0.2 * F.col("b") > 0).cast("int"))
    out = models.metrics_frame(rows, ["a", "b"], folds=2).collect()
    assert len(out) == 2 and all(r.auc > 0.9 and r.brier < 0.2 for r in out)
    fitted = models.fit_throughput(rows, ["a", "b"], "target", classify=True)
    assert fitted.transform(rows).where("prediction = target").count() > 220


def test_anchorage_shapes(spark):
    dense = [(i, 1.0 + (i % 10) * 1e-4, 2.0 + (i // 10) * 1e-4) for i in range(100)]
    rows = spark.createDataFrame([*dense, (999, 5.0, 5.0)], "point_id long, lat double, lon double")
    core = shapes.density_core(rows)
    assert core.count() == 100
    ring = shapes.hulls(core.withColumn("k", F.lit("A")), "k").first()
    assert len(ring.xs) == 4 and max(ring.ys) == pytest.approx(1.0009)


def test_ring_buffer(spark):
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.5, 1.05), (3, 0.5, 1.2)], "point_id long, lat double, lon double")
    rings = spark.createDataFrame([("Q", [0.0, 1.0, 1.0, 0.0], [0.0, 0.0, 1.0, 1.0])], "polygon_id string, xs array<double>, ys array<double>")
    assert sorted(r.point_id for r in geo.polygon_join(pts, rings, buffer=0.1).collect()) == [1, 2]
    assert [r.point_id for r in geo.polygon_join(pts, rings).collect()] == [1]


def test_seasonal_nulls(spark):
    rows = spark.createDataFrame([("a", dt.date(2024, 1, 1), None), ("a", dt.date(2024, 1, 2), 3.0)], "k string, d date, x double")
    assert [r.x for r in seasonal.winsorize(rows, ["k"]).orderBy("d").collect()] == [None, 3.0]
    assert [r.z for r in seasonal.doy_zscore(rows, ["k"]).collect()] == [0.0, 0.0]
