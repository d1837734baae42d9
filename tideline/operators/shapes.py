"""Anchorages from dwell points: density clusters and their hulls."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.columns import MERCATOR_RADIUS_M
from tideline.operators.clusters import density_clusters

#: Pieces of a quarter circle where a ring's corners are rounded.
QUARTER = 16
Ring = list[tuple[float, float]]


def density_core(points: DataFrame, eps_m: float = 350.0, least: int = 30) -> DataFrame:
    """Points (point_id, lat, lon) with at least ``least`` others and itself within ``eps_m``, with the cluster they are in."""
    return points.join(density_clusters(points, eps_m, least).where("core").drop("core"), "point_id")


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull by the monotone chain, counter-clockwise."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def chain(order: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(points) + chain(points[::-1])


def hulls(points: DataFrame, key: str) -> DataFrame:
    """The hull of each group's points. Points inside their partition's own hull go first, so groups come together small."""
    ddl = f"{key} string, xs array<double>, ys array<double>"

    def shrink(batches):
        for batch in batches:
            for k, rows in batch.groupby(key):
                ring = hull(list(zip(rows["lon"], rows["lat"])))
                yield pd.DataFrame({key: [k], "xs": [[p[0] for p in ring]], "ys": [[p[1] for p in ring]]})

    def join(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ring = hull([p for xs, ys in zip(rows["xs"], rows["ys"]) for p in zip(xs, ys)])
        return pd.DataFrame({key: [k[0]], "xs": [[p[0] for p in ring]], "ys": [[p[1] for p in ring]]})

    small = points.select(F.col(key).cast("string").alias(key), "lon", "lat").mapInPandas(shrink, ddl)
    return small.groupBy(key).applyInPandas(join, ddl)


def widened(ring: Ring, by: float) -> Ring:
    """A convex ring (counter-clockwise; a point or a line as well) with ``by`` more on every side, its corners rounded."""
    n, out = len(ring), []
    if by <= 0 or not n:
        return ring
    for k, (x, y) in enumerate(ring):
        (ax, ay), (bx, by_) = ring[k - 1], ring[(k + 1) % n]
        # from the normal of the edge before to that of the edge after
        start = math.atan2(ax - x, y - ay) if n > 1 else 0.0
        turn = (math.atan2(x - bx, by_ - y) - start) % (2 * math.pi) if n > 1 else 2 * math.pi
        steps = max(1, math.ceil(turn / (math.pi / 2 / QUARTER)))
        out += [(x + by * math.cos(start + turn * i / steps), y + by * math.sin(start + turn * i / steps)) for i in range(steps + (n > 1))]
    return out


def simplified(ring: Ring, within: float) -> Ring:
    """A ring without the points that lie ``within`` the line that stands for them; its two points farthest apart stay."""
    if within <= 0 or len(ring) < 4:
        return ring
    far = max(range(len(ring)), key=lambda i: math.dist(ring[0], ring[i]))
    start = max(range(len(ring)), key=lambda i: math.dist(ring[far], ring[i]))
    turned = ring[start:] + ring[:start] + [ring[start]]
    kept, todo = {0, len(turned) - 1, (far - start) % len(ring)}, [(0, (far - start) % len(ring)), ((far - start) % len(ring), len(turned) - 1)]
    while todo:
        i, j = todo.pop()
        (ax, ay), (bx, by) = turned[i], turned[j]
        size = math.hypot(bx - ax, by - ay)
        off = [abs((bx - ax) * (ay - y) - (ax - x) * (by - ay)) / size if size else math.dist((x, y), (ax, ay)) for x, y in turned[i + 1 : j]]
        if off and max(off) > within:
            k = i + 1 + off.index(max(off))
            kept.add(k)
            todo += [(i, k), (k, j)]
    return [turned[k] for k in sorted(kept)[:-1]]


def ring_area(ring: Ring) -> float:
    """Area within a ring, whichever way it turns."""
    return abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]))) / 2


def _metres(lon: float, lat: float) -> tuple[float, float]:
    return MERCATOR_RADIUS_M * math.radians(lon), MERCATOR_RADIUS_M * math.log(math.tan(math.pi / 4 + math.radians(lat) / 2))


def _degrees(x: float, y: float) -> tuple[float, float]:
    return math.degrees(x / MERCATOR_RADIUS_M), math.degrees(2 * math.atan(math.exp(y / MERCATOR_RADIUS_M)) - math.pi / 2)


def outlines(points: DataFrame, key: str, buffer_m: float = 120.0, simplify_m: float = 30.0) -> DataFrame:
    """``key, xs, ys, area_m2``: the hull of each group's points, widened and simplified in metres of the projection, back in degrees; the area is the projection's."""

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, xs, ys in zip(frame[key], frame["xs"], frame["ys"]):
                ring = simplified(widened(hull([_metres(x, y) for x, y in zip(xs, ys)]), buffer_m), simplify_m)
                back = [_degrees(x, y) for x, y in ring]
                rows.append((k, [p[0] for p in back], [p[1] for p in back], ring_area(ring)))
            yield pd.DataFrame(rows, columns=[key, "xs", "ys", "area_m2"])

    return hulls(points, key).mapInPandas(draw, f"{key} string, xs array<double>, ys array<double>, area_m2 double")
