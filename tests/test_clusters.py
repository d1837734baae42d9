"""Density clusters beside a plain version that compares all points."""

import math
import random

import pytest

from tideline.operators import clusters

DDL = "point_id long, lat double, lon double"


def metres(p, q):
    a, b = math.radians(p[1]), math.radians(q[1])
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
    return 2 * 6371008.8 * math.asin(min(1.0, math.sqrt(h)))


def slow_clusters(rows, eps, least):
    near = {p[0]: [q[0] for q in rows if metres(p, q) <= eps] for p in rows}
    core, label = {i for i in near if len(near[i]) >= least}, {}
    for i in sorted(core):
        stack = [i] if i not in label else []
        while stack:
            x = stack.pop()
            if x not in label:
                label[x] = i
                stack += [y for y in near[x] if y in core]
    out = {(i, c, True) for i, c in label.items()}
    return out | {(i, min(label[j] for j in near[i] if j in core), False) for i in near if i not in core and any(j in core for j in near[i])}


def got(spark, rows, eps, least):
    return {tuple(r) for r in clusters.density_clusters(spark.createDataFrame(rows, DDL).repartition(3), eps, least).collect()}


def scattered(lat, lon, n, spread_m, start, seed):
    rng = random.Random(seed)
    side = lambda: rng.gauss(0, spread_m) / 111195
    out = []
    for i in range(n):
        x = lon + side() / max(0.001, math.cos(math.radians(lat)))
        out.append((start + i, min(90.0, max(-90.0, lat + side())), (x + 180) % 360 - 180))
    return out


@pytest.mark.parametrize("lat, lon", [(0.0, 10.0), (52.0, 4.0), (-71.0, 179.9995), (89.995, 20.0), (-0.0005, -180.0)])
def test_beside_all_pairs(spark, lat, lon):
    rows = scattered(lat, lon, 120, 500, 0, 1) + scattered(lat, lon + 0.03, 60, 150, 500, 2) + scattered(lat + (0.02 if lat < 89 else -0.02), lon, 25, 2500, 900, 3)
    for eps, least in ((350.0, 10), (150.0, 4)):
        want = slow_clusters(rows, eps, least)
        assert want and got(spark, rows, eps, least) == want


def test_two_anchorages_and_the_larger_one(spark):
    rows = scattered(31.0, 32.0, 80, 200, 0, 4) + scattered(31.1, 32.0, 50, 200, 1000, 5) + [(5000, 31.05, 32.0), (5001, None, 32.0), (5002, 31.0, None)]
    found = clusters.density_clusters(spark.createDataFrame(rows, DDL), 350.0, 30)
    assert {r.cluster_id // 1000 for r in found.collect()} == {0, 1} and found.select("cluster_id").distinct().count() == 2
    most = clusters.largest_cluster(found)
    assert {r.point_id // 1000 for r in most.collect()} == {0} and most.count() > 60


def test_chains_ties_and_dense_cells(spark):
    """A chain of cells joined one by one, a gap of exactly more than the radius, and many points in one place."""
    step = 340 / 111195
    chain = [(i, 10 + step * i, 5.0) for i in range(40)] + [(100 + i, 10 + step * 39 + (351 + 340 * i) / 111195, 5.0) for i in range(5)]
    assert got(spark, chain, 350.0, 2) == slow_clusters(chain, 350.0, 2)
    heap = [(i, 1.0, 1.0) for i in range(50)] + [(100 + i, 1.0 + 349 / 111195, 1.0) for i in range(3)] + [(200, 1.0 + 500 / 111195, 1.0)]
    assert got(spark, heap, 350.0, 30) == slow_clusters(heap, 350.0, 30)
    assert got(spark, [], 350.0, 30) == set() and got(spark, [(1, 1.0, 1.0)], 350.0, 1) == {(1, 1, True)}


def test_components_of_a_long_path(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001)]
    found = {r.node: r.component for r in clusters.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}
