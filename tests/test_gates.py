"""Geodesics beside published values and their own inverse; gates of several axes at once."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import gates

PLACES = "lat1 double, lon1 double, lat2 double, lon2 double"


def dms(d, m, s):
    return math.copysign(abs(d) + m / 60 + s / 3600, d)


def solved(spark, rows):
    df = spark.createDataFrame(rows, PLACES).select(gates.inverse(*[F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")]).alias("g"))
    return [(r.g.metres, r.g.azimuth) for r in df.collect()]


def test_published_lines(spark):
    """Flinders Peak to Buninyong (54,972.271 m at 306 52 05.37), a degree of the equator and of the meridian there, over the date line, no way at all."""
    rows = [
        (dms(-37, 57, 3.7203), dms(144, 25, 29.5244), dms(-37, 39, 10.1561), dms(143, 55, 35.3839)),
        (0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 1.0, 0.0), (0.0, 179.5, 0.0, -179.5), (10.0, 20.0, 10.0, 20.0),
    ]
    got = solved(spark, rows)
    assert got[0] == (pytest.approx(54972.271, abs=0.01), pytest.approx(dms(306, 52, 5.37), abs=1e-5))
    assert got[1] == (pytest.approx(111319.491, abs=0.001), 90.0) and got[2] == (pytest.approx(110574.389, abs=0.001), 0.0)
    assert got[3] == (pytest.approx(111319.491, abs=0.001), 90.0) and got[4] == (0.0, None)


def test_direct_and_inverse_meet(spark):
    rng = random.Random(2)
    rows = [(rng.uniform(-85, 85), rng.uniform(-180, 180), rng.uniform(0, 360), 10 ** rng.uniform(1, 6.5)) for _ in range(200)]
    df = spark.createDataFrame(rows, "lat double, lon double, az double, m double")
    df = df.withColumn("p", gates.direct(F.col("lat"), F.col("lon"), F.col("az"), F.col("m")))
    for r in df.withColumn("g", gates.inverse(F.col("lat"), F.col("lon"), F.col("p.lat"), F.col("p.lon"))).collect():
        assert r.g.metres == pytest.approx(r.m, abs=1e-3)
        assert r.m * math.radians(abs((r.g.azimuth - r.az + 180) % 360 - 180)) < 0.01


def test_gates_of_two_axes(spark):
    """North along a meridian from an entry beside its second vertex, and east along the equator from its end: gates stand square, a mile or two to each side."""
    mile = 1852 / 110574.389
    axes = [("N", i, 30.0, i * mile) for i in range(12)] + [("E", i, 10.0 + i * 1852 / 111319.491, 0.0) for i in range(4)]
    entries = [("N", 30.001, mile * 1.1), ("E", 10.0, 0.0)]
    found = gates.approach_gates(
        spark.createDataFrame(axes, "axis_id string, seq int, lon double, lat double"), spark.createDataFrame(entries, "axis_id string, lon double, lat double"), [0, 2, 5], {5: 2.0}
    )
    got = {r.gate_id: r for r in found.collect()}
    assert sorted(got) == sorted(f"GATE_{a}_{d}NM" for a in "NE" for d in (0, 2, 5))
    assert got["GATE_N_2NM"].lat == pytest.approx(3 * mile) and got["GATE_N_5NM"].lat == pytest.approx(6 * mile) and got["GATE_N_0NM"].azimuth == pytest.approx(0.0)
    # the axis ends three miles on: the last vertex stands for five
    assert got["GATE_E_5NM"].lon == pytest.approx(10.0 + 3 * 1852 / 111319.491) and got["GATE_E_0NM"].azimuth == pytest.approx(90.0)
    ends = [(r.left_lat, r.left_lon, r.right_lat, r.right_lon) for r in (got["GATE_N_2NM"], got["GATE_E_5NM"])]
    assert [m for m, _ in solved(spark, ends)] == pytest.approx([2 * 1852, 4 * 1852], abs=0.5)
    assert got["GATE_N_2NM"].left_lon < 30 < got["GATE_N_2NM"].right_lon and got["GATE_E_5NM"].left_lat > 0 > got["GATE_E_5NM"].right_lat
