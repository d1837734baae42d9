"""Outlines: areas beside their closed form, simplification beside its bound."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import shapes


def polygon(n, radius):
    return [(radius * math.cos(2 * math.pi * i / n), radius * math.sin(2 * math.pi * i / n)) for i in range(n)]


@pytest.mark.parametrize("ring", [[(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0)], polygon(3, 80), polygon(7, 50), polygon(12, 500), [(0.0, 0.0), (40.0, 0.0)], [(3.0, 4.0)]])
def test_widened_area(ring):
    around = sum(math.dist(p, q) for p, q in zip(ring, ring[1:] + ring[:1])) if len(ring) > 1 else 0.0
    for by in (10.0, 120.0):
        want = shapes.ring_area(ring) + around * by + math.pi * by * by
        assert shapes.ring_area(shapes.widened(ring, by)) == pytest.approx(want, rel=0.01)
    assert shapes.widened(ring, 0.0) == ring


def test_simplified_stays_within_its_bound():
    rng = random.Random(1)
    ring = [(x + rng.uniform(-2, 2), y + rng.uniform(-2, 2)) for x, y in polygon(400, 300)]
    slim = shapes.simplified(ring, 8.0)
    assert 6 < len(slim) < 60 and set(slim) <= set(ring)

    def apart(p):
        best = math.inf
        for (ax, ay), (bx, by) in zip(slim, slim[1:] + slim[:1]):
            t = min(1.0, max(0.0, ((p[0] - ax) * (bx - ax) + (p[1] - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
            best = min(best, math.dist(p, (ax + t * (bx - ax), ay + t * (by - ay))))
        return best

    assert max(map(apart, ring)) <= 8.0 + 1e-9 and shapes.simplified(ring, 0.0) == ring
    assert shapes.ring_area(shapes.simplified(shapes.widened(polygon(4, 1000), 120.0), 5.0)) == pytest.approx(shapes.ring_area(shapes.widened(polygon(4, 1000), 120.0)), rel=0.01)


def test_outlines_in_degrees(spark):
    """A square of 2 km at the equator, widened by 120 m; a single point is a circle."""
    step = 1000 / 111319.49
    rows = [("sq", step * i, step * j) for i in (-1, 0, 1) for j in (-1, 0, 1)] + [("dot", 0.5, 20.0)]
    got = {r.k: r for r in shapes.outlines(spark.createDataFrame(rows, "k string, lat double, lon double").repartition(3), "k", simplify_m=1.0).collect()}
    assert got["sq"].area_m2 == pytest.approx(2000**2 + 4 * 2000 * 120 + math.pi * 120**2, rel=0.01)
    assert max(got["sq"].xs) == pytest.approx(step * 1.12, rel=1e-3) and got["dot"].area_m2 == pytest.approx(math.pi * 120**2, rel=0.03)
    assert shapes.outlines(spark.createDataFrame([], "k string, lat double, lon double"), "k").count() == 0


def test_core_points_at_high_latitude(spark):
    rows = [(i, 75.0 + (i // 10) * 1e-4, 30.0 + (i % 10) * 4e-4) for i in range(60)] + [(99, 76.0, 30.0)]
    core = shapes.density_core(spark.createDataFrame(rows, "point_id long, lat double, lon double"))
    assert core.count() == 60 and core.select("cluster_id").distinct().collect()[0][0] == 0
    assert core.where(F.col("point_id") == 99).count() == 0
