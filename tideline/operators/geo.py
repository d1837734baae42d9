"""Geometry in columns: regions, polygons, grids, neighbours and implausible speeds.

Polygons are small dimensions of straight-edged rings (arrays of x and y); tests are plain column maths.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.columns import EARTH_NM, MERCATOR_RADIUS_M, epoch_seconds, haversine

#: Degrees to kilometres, as the nearest-cell scores take it.
KM_PER_DEGREE = 111.0


def mercator(lat: Column | str, lon: Column | str) -> tuple[Column, Column]:
    """Forward Mercator in metres."""
    lat = F.col(lat) if isinstance(lat, str) else lat
    lon = F.col(lon) if isinstance(lon, str) else lon
    return F.radians(lon) * MERCATOR_RADIUS_M, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * MERCATOR_RADIUS_M


def region_of(lat: Column | str, lon: Column | str, boxes: list[tuple[str, float, float, float, float]]) -> Column:
    """Name of the first of the boxes (name, south, west, north, east) that holds the point; null if none does."""
    lat = F.col(lat) if isinstance(lat, str) else lat
    lon = F.col(lon) if isinstance(lon, str) else lon
    return F.coalesce(*[F.when(lat.between(s, n) & lon.between(w, e), name) for name, s, w, n, e in boxes])


def box_join(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points with every box that holds them; ``boxes`` (name, south, west, north, east) is a small dimension.

    Both sides are keyed by whole-degree cells, a box once for each cell it touches, so the join is on equal keys.
    """
    touched = boxes.withColumn("_i", F.explode(F.sequence(F.floor("south"), F.floor("north")))).withColumn(
        "_j", F.explode(F.sequence(F.floor("west"), F.floor("east")))
    )
    keyed = points.withColumn("_i", F.floor("lat")).withColumn("_j", F.floor("lon"))
    inside = F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east"))
    return keyed.join(touched, ["_i", "_j"]).where(inside).drop("_i", "_j", "south", "north", "west", "east")


def in_ring(x: Column, y: Column, xs: Column, ys: Column) -> Column:
    """Whether a point lies inside a closed ring (ray casting): an odd number of edges to its right cross its height."""

    def crosses(i: Column) -> Column:
        j = F.pmod(i + 1, F.size(xs))
        x1, y1, x2, y2 = F.get(xs, i), F.get(ys, i), F.get(xs, j), F.get(ys, j)
        at = (x2 - x1) * F.try_divide(y - y1, y2 - y1) + x1
        return F.when(((y1 > y) != (y2 > y)) & (x < at), 1).otherwise(0)

    edges = F.sequence(F.lit(0), F.size(xs) - 1)
    return F.aggregate(edges, F.lit(0), lambda total, i: total + crosses(i)) % 2 == 1


def ring_distance(x: Column, y: Column, xs: Column, ys: Column) -> Column:
    """Distance from a point to the nearest edge of a ring."""

    def to_edge(i: Column) -> Column:
        j = F.pmod(i + 1, F.size(xs))
        x1, y1, dx, dy = F.get(xs, i), F.get(ys, i), F.get(xs, j) - F.get(xs, i), F.get(ys, j) - F.get(ys, i)
        t = F.coalesce(F.try_divide((x - x1) * dx + (y - y1) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        return F.hypot(x - (x1 + t * dx), y - (y1 + t * dy))

    return F.array_min(F.transform(F.sequence(F.lit(0), F.size(xs) - 1), to_edge))


def polygon_join(points: DataFrame, polygons: DataFrame, buffer: float = 0.0) -> DataFrame:
    """Points with every polygon (polygon_id, xs, ys: a small dimension) that holds them or is within ``buffer`` of them."""
    keyed = polygons.withColumns(
        {
            "south": F.array_min("ys") - buffer, "north": F.array_max("ys") + buffer,
            "west": F.array_min("xs") - buffer, "east": F.array_max("xs") + buffer,
        }
    )
    near = box_join(points, keyed)
    x, y, xs, ys = F.col("lon"), F.col("lat"), F.col("xs"), F.col("ys")
    inside = in_ring(x, y, xs, ys)
    if buffer:
        inside = inside | (ring_distance(x, y, xs, ys) <= buffer)
    return near.where(inside).drop("xs", "ys")


def nearest_cell(points: DataFrame, grid: DataFrame, lat0: float, lon0: float, step: float) -> DataFrame:
    """Points joined with the regular grid's nearest cell on each axis; grid cells carry integer ``i`` and ``j``."""
    snap = lambda c, start: F.floor((F.col(c) - start) / step + 0.5).cast("int")
    return points.withColumn("i", snap("lat", lat0)).withColumn("j", snap("lon", lon0)).join(grid, ["i", "j"], "left")


def knn_cells(
    points: DataFrame, cells: DataFrame, k: int = 5, most_km: float = 50.0, most_hours: float = 3.0, width: float = 0.5, levels: int = 5
) -> DataFrame:
    """Of each point's ``k`` nearest cells by degrees, the one with the least ``km + 10 hours``.

    The cut to ``k`` comes before the gates on distance and time. ``width`` (degrees) must be at least the distance
    gate. Distances within 1e-9 degrees tie, and the earlier time goes first.

    The ``k`` nearest depend on a point's place alone, and of the cells of one place only the first ``k`` by time and
    value can be among them: so places are joined, not rows. Where a place's own square of half a bucket's side holds
    ``k`` cells, the ``k`` nearest are within the neighbouring buckets; each place takes the narrowest of ``levels``
    buckets, halved from ``width``, for which that holds, else the widest.
    """
    side = F.lit(float(width)) / F.pow(F.lit(2.0), F.col("_l"))
    square = lambda c, size: F.floor(F.col(c) / size)
    # -0.0 is the place 0.0
    place = lambda df: df.withColumns({"lat": F.col("lat") + F.lit(0.0), "lon": F.col("lon") + F.lit(0.0)})
    same = Window.partitionBy("lat", "lon").orderBy("ts", "value")
    cells = place(cells.select("lat", "lon", "ts", "value")).withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= k).drop("_r")
    points = place(points)
    places = points.select("lat", "lon").distinct()

    ladder = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("_l")
    keyed = cells.select("lat", "lon", ladder).groupBy("_l", square("lat", side / 2).alias("_i"), square("lon", side / 2).alias("_j"))
    full = keyed.count().where(F.col("count") >= k).drop("count")
    tried = places.select("lat", "lon", ladder).select("*", square("lat", side / 2).alias("_i"), square("lon", side / 2).alias("_j"))
    own = tried.join(full, ["_l", "_i", "_j"], "left_semi").groupBy("lat", "lon").agg(F.max("_l").alias("_l"))
    near = F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = places.join(own, ["lat", "lon"], "left").withColumn("_l", F.coalesce("_l", F.lit(0))).withColumn("_n", F.explode(near))
    spread = spread.withColumn("_i", square("lat", side) + F.col("_n.di")).withColumn("_j", square("lon", side) + F.col("_n.dj"))
    held = cells.select("*", ladder).select(
        "_l", square("lat", side).alias("_i"), square("lon", side).alias("_j"),
        F.col("lat").alias("cell_lat"), F.col("lon").alias("cell_lon"), F.col("ts").alias("cell_ts"), "value",
    )
    joined = spread.join(held, ["_l", "_i", "_j"])
    degrees = F.hypot(F.col("lat") - F.col("cell_lat"), F.col("lon") - F.col("cell_lon"))
    joined = joined.select("lat", "lon", degrees.alias("_d"), "cell_ts", "cell_lat", "cell_lon", "value")
    firsts = lambda df, *by: df.withColumn(
        "_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.round("_d", 9), "cell_ts", "cell_lat", "cell_lon", "value"))
    ).where(F.col("_r") <= k)
    nearest = firsts(joined, "lat", "lon").drop("_r")
    # once more, for ids that come with several rows
    first = firsts(points.select("point_id", "lat", "lon", "ts").join(nearest, ["lat", "lon"]), "point_id")
    seconds = F.abs(epoch_seconds("ts") - epoch_seconds("cell_ts"))
    scored = first.select("*", (F.col("_d") * KM_PER_DEGREE).alias("km"), (seconds / 3600.0).alias("hours"))
    scored = scored.where((F.col("km") <= most_km) & (F.col("hours") <= most_hours))
    best = F.min_by(F.struct("value", "km", "hours"), F.struct(F.round(F.col("km") + 10 * F.col("hours"), 6), F.col("_r")))
    return scored.groupBy("point_id").agg(best.alias("b")).select("point_id", "b.value", "b.km", "b.hours")


def implausible(fixes: DataFrame, limit_kn: float = 40.0) -> DataFrame:
    """Fixes that imply a speed above ``limit_kn`` since the vessel's fix before."""
    order = Window.partitionBy("mmsi").orderBy("ts")
    seen = fixes.withColumns({"_lat": F.lag("lat").over(order), "_lon": F.lag("lon").over(order), "_ts": F.lag("ts").over(order)})
    hours = (epoch_seconds("ts") - epoch_seconds("_ts")) / 3600.0
    speed = F.try_divide(haversine("_lat", "_lon", "lat", "lon", EARTH_NM), hours)
    return seen.withColumn("implied_kn", speed).where(F.col("implied_kn") > limit_kn).drop("_lat", "_lon", "_ts")


def interpolate(tracks: DataFrame, n: int) -> DataFrame:
    """``n`` positions along the straight line from start to end of each track, with their times."""
    step = F.col("k") / F.lit(float(n - 1))
    along = lambda a, b: F.col(a) + step * (F.col(b) - F.col(a))
    seconds = epoch_seconds("start_ts") + step * (epoch_seconds("end_ts") - epoch_seconds("start_ts"))
    return tracks.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(
        "track_id", "k", along("lat0", "lat1").alias("lat"), along("lon0", "lon1").alias("lon"), F.floor(seconds).alias("epoch")
    )
