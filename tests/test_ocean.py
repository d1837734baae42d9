"""Boxes widened and cut at the date line, grids of either count."""

import math

import pytest
from pyspark.sql import functions as F

from tideline.operators import ocean

BOX_DDL = "name string, south double, west double, north double, east double, bearing_deg double"


def parts(spark, box, km):
    return sorted((r.south, r.west, r.north, r.east) for r in ocean.widened(spark.createDataFrame([("b", *box, 0.0)], BOX_DDL), km).collect())


@pytest.mark.parametrize(
    "box, km, want",
    [
        ((0.0, 10.0, 0.0, 20.0), 111.0, [(-1.0, 9.0, 1.0, 21.0)]),
        ((60.0, 10.0, 60.0, 20.0), 111.0, [(59.0, 8.0, 61.0, 22.0)]),
        ((0.0, 170.0, 0.0, -170.0), 0.0, [(0.0, -180.0, 0.0, -170.0), (0.0, 170.0, 0.0, 180.0)]),
        ((0.0, 178.0, 0.0, 179.5), 111.0, [(-1.0, -180.0, 1.0, -179.5), (-1.0, 177.0, 1.0, 180.0)]),
        ((89.0, -100.0, 90.0, 100.0), 1110.0, [(79.0, -180.0, 90.0, 180.0)]),
        ((0.0, 190.0, 1.0, 200.0), 0.0, [(0.0, -170.0, 1.0, -160.0)]),
    ],
)
def test_widened_boxes(spark, box, km, want):
    assert parts(spark, box, km) == [pytest.approx(p) for p in want]


def test_features_of_a_grid_counted_to_360(spark):
    cells = [("t0", 0.5, lon, float(k), 3.0, 4.0) for k, lon in enumerate((179.5, 180.0, 180.5, 190.5, 359.9))] + [("t1", 0.5, 180.0, math.nan, 1.0, 0.0)]
    grid = spark.createDataFrame(cells, "ts string, lat double, lon double, hs double, u double, v double")
    seas = spark.createDataFrame([("line", 0.0, 179.0, 1.0, -179.0, 90.0), ("none", 50.0, 0.0, 51.0, 1.0, 0.0)], BOX_DDL)
    wanted = [ocean.Feature("wave", "scalar", ("hs",), ("mean", "p95")), ocean.Feature("speed", "vector", ("u", "v")), ocean.Feature("against", "opposing", ("u", "v"))]
    got = {(r.name, r.ts): tuple(r)[2:] for r in ocean.region_features(grid, seas, wanted).collect()}
    assert got == {("line", "t0"): pytest.approx((1.0, 1.9, 5.0, -4.0)), ("line", "t1"): (None, None, 1.0, pytest.approx(0.0))}
    west = grid.withColumn("lon", F.when(F.col("lon") >= 180, F.col("lon") - 360).otherwise(F.col("lon")))
    assert {(r.name, r.ts): r.wave_mean for r in ocean.region_features(west, seas, wanted).collect()} == {k: v[0] for k, v in got.items()}
    whole = ocean.region_metrics(grid, seas, wanted).first()
    assert (whole.cells, whole.times, whole.newest, whole.wave_mean) == (4, 2, "t1", 1.0)
    with pytest.raises(ValueError):
        ocean.Feature("x", "vector", ("u",)).value(F.lit(0.0))
