"""Nearest cells at shared places and of ids with several rows, against brute force."""

import datetime as dt
import math
import time

from pyspark.sql import functions as F

from tideline.operators import geo

AT = dt.datetime(2024, 1, 10)
POINT, CELL = "point_id long, lat double, lon double, ts timestamp_ntz", "lat double, lon double, ts timestamp_ntz, value double"


def brute(points, cells, k=5, most_km=50.0, most_hours=6.0):
    seen = {}
    for pid, lat, lon, ts in points:
        for a, o, cts, value in cells:
            d = math.hypot(lat - a, lon - o)
            seen.setdefault(pid, []).append((round(d, 9), cts, a, o, value, d, abs((ts - cts).total_seconds()) / 3600))
    out = {}
    for pid, rows in seen.items():
        found = [(round(d * 111 + 10 * h, 6), i, v) for i, (_, _, _, _, v, d, h) in enumerate(sorted(rows)[:k]) if d * 111 <= most_km and h <= most_hours]
        if found:
            out[pid] = min(found)[2]
    return out


def test_places_and_ids_with_several_rows(spark):
    minutes = lambda n: AT + dt.timedelta(minutes=n)
    # a dense place with many equal coordinates, a sparse one whose cells lie up to 0.4 degrees apart
    cells = [(0.01 * (i % 3), -0.0 if i % 2 else 0.0, minutes(i * 37 % 500 - 250), float(i)) for i in range(60)]
    cells += [(10.0 + 0.13 * i, 10.0 - 0.09 * i, minutes(i * 50 - 90), 100.0 + i) for i in range(-3, 4)]
    # id 1 has a row at either place, id 2 the same row twice, id 4 only the sparse place, id 5 nothing near
    points = [(1, 0.0, 0.0, minutes(400)), (1, 10.05, 10.0, AT), (2, 0.0, 0.0, AT), (2, 0.0, 0.0, AT), (3, -0.0, 0.0, minutes(30)),
              (4, 10.05, 10.0, AT), (5, 50.0, 50.0, AT)]
    for own in (points, points[1:], [(9, 0.0, 0.0, minutes(2000)), (9, 10.05, 10.0, AT)]):
        got = geo.knn_cells(spark.createDataFrame(own, POINT), spark.createDataFrame(cells, CELL), most_hours=6.0, width=0.6)
        assert {r.point_id: r.value for r in got.collect()} == brute(own, cells)


def test_rows_at_one_place_are_not_paired(spark):
    """8,000 points and 40,000 cells at two places: as pairs of rows there would be 320 million."""
    cells = spark.range(40_000).select(
        (F.col("id") % 2 / 100.0).alias("lat"), F.lit(0.0).alias("lon"),
        (F.lit(AT).cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") % 600 - 300).cast("int"))).alias("ts"), F.col("id").cast("double").alias("value"),
    )
    points = spark.range(8_000).select(F.col("id").alias("point_id"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.lit(AT).cast("timestamp_ntz").alias("ts"))
    began = time.perf_counter()
    got = geo.knn_cells(points, cells, most_hours=6.0, width=0.6).select("value").groupBy("value").count().collect()
    # of the first five by time the first by value: id % 600 is 0
    assert [(r.value, r["count"]) for r in got] == [(0.0, 8_000)]
    assert time.perf_counter() - began < 60
