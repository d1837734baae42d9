"""Density clusters of places, over cells in metres.

A cell's diagonal is at most the radius, so all points of a cell are neighbours of each other: a cell with enough points
holds core points only, and the core points of a cell are in one cluster. Points are therefore compared only where a
cell has too few, and clusters are components of cells. Columns of cells are as wide at every latitude: bands near the
poles have fewer. Places on both sides of the date line are neighbours.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.columns import EARTH_KM, haversine
from tideline.functions.storage import cut

EARTH_M = EARTH_KM * 1000
METRES_PER_DEGREE = math.radians(EARTH_M)


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the least node reachable) for every node of ``links`` (a, b).

    Labels go to neighbours and then skip to the label of their label, so rounds grow with the logarithm of the longest
    path; each round's labels are cut off from those before.
    """
    edges = cut(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct())
    labels = cut(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")))
    while True:
        met = edges.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        lower = cut(labels.join(met, "u").select("u", F.least("label", "near").alias("label"), F.col("label").alias("was")))
        skip = lower.select(F.col("u").alias("label"), F.col("label").alias("next"))
        labels = cut(lower.join(skip, "label").select("u", F.least("label", "next").alias("label"), "was"))
        changed = labels.where("label < was").limit(1).count()
        labels = labels.drop("was")
        if not changed:
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))


def _column_width(band: Column, side: float) -> Column:
    """Cells for each degree of longitude in a band, by its edge nearer to the equator."""
    edge = lambda b: F.cos(F.radians(b * (side / METRES_PER_DEGREE)))
    return F.greatest(edge(band), edge(band + 1)) * (METRES_PER_DEGREE / side)


def _band(lat: Column, side: float) -> Column:
    return F.floor(lat * (METRES_PER_DEGREE / side))


def _reached(boxes: DataFrame, eps_m: float, side: float) -> DataFrame:
    """``boxes`` (south, north, west, east) once for each cell (``i, j``) that a point within ``eps_m`` of one can lie in."""
    r, degrees = eps_m / EARTH_M, eps_m / METRES_PER_DEGREE
    high = F.radians(F.greatest(F.abs("south"), F.abs("north")))
    reach = F.when(high + r < math.pi / 2, F.degrees(F.asin(F.sin(F.lit(r)) / F.cos(high)))).otherwise(180.0)
    around = F.col("east") - F.col("west") + 2 * reach >= 360
    out = boxes.withColumns({"_west": F.when(around, -180.0).otherwise(F.col("west") - reach), "_east": F.when(around, 180.0).otherwise(F.col("east") + reach)})
    out = out.withColumn("i", F.explode(F.sequence(_band(F.col("south") - degrees, side), _band(F.col("north") + degrees, side))))
    out = out.withColumn("_w", _column_width(F.col("i"), side))
    # beyond 180 degrees the range goes on at the other end
    shifts = F.filter(F.array(F.lit(-360.0), F.lit(0.0), F.lit(360.0)), lambda s: (F.col("_west") + s <= 180) & (F.col("_east") + s >= -180))
    cell = lambda x: F.floor(F.greatest(F.lit(-180.0), F.least(F.lit(180.0), x)) * F.col("_w"))
    ranges = F.transform(shifts, lambda s: F.sequence(cell(F.col("_west") + s), cell(F.col("_east") + s)))
    return out.withColumn("j", F.explode(F.array_distinct(F.flatten(ranges)))).drop("_west", "_east", "_w")


def _near_points(points: DataFrame, others: DataFrame, eps_m: float, side: float) -> DataFrame:
    """``points`` (point_id, lat, lon) with each of ``others`` (i, j, lat2, lon2, ...) within ``eps_m``."""
    boxes = points.select("point_id", "lat", "lon", F.col("lat").alias("south"), F.col("lat").alias("north"), F.col("lon").alias("west"), F.col("lon").alias("east"))
    met = _reached(boxes, eps_m, side).drop("south", "north", "west", "east").join(others, ["i", "j"])
    return met.where(haversine("lat", "lon", "lat2", "lon2", EARTH_M) <= eps_m)


def _cell_links(core: DataFrame, eps_m: float, side: float) -> DataFrame:
    """``a, b``: cells with core points within ``eps_m`` of each other, enough of them to join all that are.

    The outermost points of two cells are compared first; only pairs of cells which that leaves apart, and which no
    other cells join, are compared point by point.
    """
    place, ways = F.struct("lat", "lon"), [F.col("lat"), F.col("lon"), F.col("lat") + F.col("lon"), F.col("lat") - F.col("lon")]
    ends = F.array_distinct(F.array(*[f(place, w) for w in ways for f in (F.min_by, F.max_by)]))
    boxes = cut(
        core.groupBy("cell", "i", "j").agg(
            ends.alias("ends"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east")
        )
    )
    here = _reached(boxes.select("south", "north", "west", "east", F.col("cell").alias("a"), F.col("ends").alias("x")), eps_m, side).drop("south", "north", "west", "east")
    pairs = here.join(boxes.select("i", "j", F.col("cell").alias("b"), F.col("ends").alias("y")), ["i", "j"]).where("a < b")
    close = lambda p: lambda q: haversine(p["lat"], p["lon"], q["lat"], q["lon"], EARTH_M) <= eps_m
    pairs = cut(pairs.select("a", "b", F.exists("x", lambda p: F.exists("y", close(p))).alias("near")))
    sure = pairs.where("near").select("a", "b")
    named = components(sure)
    label = lambda end: named.select(F.col("node").alias(end), F.col("component").alias(f"{end}_label"))
    left = pairs.where("NOT near").join(label("a"), "a", "left").join(label("b"), "b", "left")
    left = left.where(F.coalesce("a_label", "a") != F.coalesce("b_label", "b")).select("a", "b")
    own = core.select(F.col("cell").alias("a"), "lat", "lon")
    other = core.select(F.col("cell").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    degrees = eps_m / METRES_PER_DEGREE
    bounds = boxes.select(F.col("cell").alias("b"), (F.col("south") - degrees).alias("low"), (F.col("north") + degrees).alias("high"))
    facing = left.join(bounds, "b").join(own, "a").where(F.col("lat").between(F.col("low"), F.col("high")))
    found = facing.join(other, "b").where(haversine("lat", "lon", "lat2", "lon2", EARTH_M) <= eps_m).select("a", "b").distinct()
    return sure.union(found)


def density_clusters(points: DataFrame, eps_m: float = 350.0, least: int = 30) -> DataFrame:
    """``point_id, cluster_id, core`` for the points (point_id, lat, lon) of clusters; the rest are noise.

    A core point has ``least`` points within ``eps_m``, itself included; core points within ``eps_m`` are in one cluster,
    named by its smallest core point. Another point within ``eps_m`` of core points is in the first of their clusters.
    Points without a place are noise.
    """
    side = 0.999 * eps_m / math.sqrt(2)
    placed = points.select("point_id", "lat", "lon").where("lat IS NOT NULL AND lon IS NOT NULL").withColumn("i", _band(F.col("lat"), side))
    placed = placed.withColumn("j", F.floor(F.col("lon") * _column_width(F.col("i"), side)))
    placed = cut(placed.withColumn("cell", F.shiftleft("i", 32) + F.col("j")))
    full = placed.groupBy("cell").count().where(F.col("count") >= least).select("cell")
    alone = cut(placed.join(full, "cell", "left_anti"))
    others = placed.select("i", "j", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    counts = _near_points(alone, others, eps_m, side).groupBy("point_id").count().where(F.col("count") >= least).select("point_id")
    core = cut(placed.join(full, "cell", "left_semi").unionByName(alone.join(counts, "point_id", "left_semi")))
    named = components(_cell_links(core, eps_m, side))
    core = core.join(named.withColumnRenamed("node", "cell"), "cell", "left").withColumn("component", F.coalesce("component", "cell"))
    firsts = core.groupBy("component").agg(F.min("point_id").alias("cluster_id"))
    core = cut(core.join(firsts, "component").select("point_id", "lat", "lon", "i", "j", "cluster_id"))
    rest = alone.join(core.select("point_id"), "point_id", "left_anti")
    around = core.select("i", "j", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), "cluster_id")
    border = _near_points(rest, around, eps_m, side).groupBy("point_id").agg(F.min("cluster_id").alias("cluster_id"))
    return core.select("point_id", "cluster_id", F.lit(True).alias("core")).union(border.select("point_id", "cluster_id", F.lit(False)))


def largest_cluster(clusters: DataFrame) -> DataFrame:
    """The points of the cluster with most points, the first of those by id."""
    sizes = clusters.groupBy("cluster_id").count().orderBy(F.desc("count"), "cluster_id").limit(1)
    return clusters.join(F.broadcast(sizes.select("cluster_id")), "cluster_id")
