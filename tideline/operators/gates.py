"""Gates across the axes of approaches: geodesics on the ellipsoid as columns, distances along a line by sums, transects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The WGS 84 ellipsoid, metres in a nautical mile.
AXIS_M = 6378137.0
FLATTENING = 1 / 298.257223563
POLAR_M = AXIS_M * (1 - FLATTENING)
MILE_M = 1852.0
#: Rounds of the longitude's and the arc's iterations; the last changes are below a tenth of a millimetre but for points almost opposite each other.
ROUNDS = 10


def _let(values: dict[str, Column], then: Callable[[Column], Column]) -> Column:
    """``then`` of a struct of values that are computed once."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), then), F.lit(0))


def _reduced(lat: Column) -> Column:
    return F.atan((1 - FLATTENING) * F.tan(F.radians(lat)))


def _spread(cos2: Column) -> tuple[Column, Column]:
    """The two series of the arc's length in the squared cosine of the geodesic's azimuth at the equator."""
    u = cos2 * (AXIS_M**2 - POLAR_M**2) / POLAR_M**2
    return 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))), u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))


def _correction(b: Column, sin: Column, cos: Column, middle: Column) -> Column:
    inner = b / 6 * middle * (-3 + 4 * sin * sin) * (-3 + 4 * middle * middle)
    return b * sin * (middle + b / 4 * (cos * (-1 + 2 * middle * middle) - inner))


def inverse(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """``metres, azimuth`` (degrees, 0 to 360) of the geodesic from one place to another; 0 and null for one and the same place."""

    def arc(ends: Column, lam: Column) -> dict[str, Column]:
        east, north = F.cos(ends["u2"]) * F.sin(lam), F.cos(ends["u1"]) * F.sin(ends["u2"]) - F.sin(ends["u1"]) * F.cos(ends["u2"]) * F.cos(lam)
        return {"east": east, "north": north, "sin": F.hypot(east, north), "cos": F.sin(ends["u1"]) * F.sin(ends["u2"]) + F.cos(ends["u1"]) * F.cos(ends["u2"]) * F.cos(lam)}

    def at_equator(ends: Column, a: Column, lam: Column) -> dict[str, Column]:
        alpha = F.coalesce(F.try_divide(F.cos(ends["u1"]) * F.cos(ends["u2"]) * F.sin(lam), a["sin"]), F.lit(0.0))
        cos2 = 1 - alpha * alpha
        middle = F.coalesce(a["cos"] - F.try_divide(2 * F.sin(ends["u1"]) * F.sin(ends["u2"]), F.when(cos2 > 1e-15, cos2)), F.lit(0.0))
        return {"alpha": alpha, "cos2": cos2, "middle": middle, "sigma": F.atan2(a["sin"], a["cos"]), "sin": a["sin"], "cos": a["cos"], "east": a["east"], "north": a["north"]}

    def next_lam(ends: Column, lam: Column) -> Column:
        def moved(e: Column) -> Column:
            c = FLATTENING / 16 * e["cos2"] * (4 + FLATTENING * (4 - 3 * e["cos2"]))
            return ends["l"] + (1 - c) * FLATTENING * e["alpha"] * (e["sigma"] + c * e["sin"] * (e["middle"] + c * e["cos"] * (-1 + 2 * e["middle"] * e["middle"])))

        return _let(arc(ends, lam), lambda a: _let(at_equator(ends, a, lam), moved))

    def told(e: Column) -> Column:
        a, b = _spread(e["cos2"])
        metres = POLAR_M * a * (e["sigma"] - _correction(b, e["sin"], e["cos"], e["middle"]))
        azimuth = F.pmod(F.degrees(F.atan2(e["east"], e["north"])), F.lit(360.0))
        return F.struct(metres.alias("metres"), F.when(e["sin"] != 0, azimuth).alias("azimuth"))

    def solved(ends: Column) -> Column:
        lam = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), ends["l"], lambda x, _: next_lam(ends, x))
        return _let({"lam": lam}, lambda k: _let(arc(ends, k["lam"]), lambda a: _let(at_equator(ends, a, k["lam"]), told)))

    across = F.pmod(lon2 - lon1 + 180, F.lit(360.0)) - 180
    return _let({"u1": _reduced(lat1), "u2": _reduced(lat2), "l": F.radians(across)}, solved)


def direct(lat: Column, lon: Column, azimuth: Column, metres: Column) -> Column:
    """``lat, lon`` (-180 to 180) of the place that lies so many metres off in a direction."""

    def begun(s: Column) -> Column:
        alpha = F.cos(s["u"]) * F.sin(s["az"])
        cos2 = 1 - alpha * alpha
        a, b = _spread(cos2)
        return _let({"u": s["u"], "az": s["az"], "alpha": alpha, "cos2": cos2, "b": b, "first": s["m"] / (POLAR_M * a), "start": F.atan2(F.tan(s["u"]), F.cos(s["az"]))}, arrived)

    def arrived(s: Column) -> Column:
        middle = lambda sigma: F.cos(2 * s["start"] + sigma)
        sigma = F.aggregate(
            F.sequence(F.lit(1), F.lit(ROUNDS)), s["first"], lambda x, _: s["first"] + _correction(s["b"], F.sin(x), F.cos(x), middle(x))
        )
        return _let({"s": sigma, "m": middle(sigma)}, lambda k: ended(s, k))

    def ended(s: Column, k: Column) -> Column:
        sin, cos = F.sin(k["s"]), F.cos(k["s"])
        up = F.sin(s["u"]) * sin - F.cos(s["u"]) * cos * F.cos(s["az"])
        lat2 = F.atan2(F.sin(s["u"]) * cos + F.cos(s["u"]) * sin * F.cos(s["az"]), (1 - FLATTENING) * F.hypot(s["alpha"], up))
        lam = F.atan2(sin * F.sin(s["az"]), F.cos(s["u"]) * cos - F.sin(s["u"]) * sin * F.cos(s["az"]))
        c = FLATTENING / 16 * s["cos2"] * (4 + FLATTENING * (4 - 3 * s["cos2"]))
        east = lam - (1 - c) * FLATTENING * s["alpha"] * (k["s"] + c * sin * (k["m"] + c * cos * (-1 + 2 * k["m"] * k["m"])))
        return F.struct(F.degrees(lat2).alias("lat"), F.degrees(east).alias("east"))

    found = _let({"u": _reduced(lat), "az": F.radians(azimuth), "m": metres}, begun)
    return _let({"f": found}, lambda k: F.struct(k["f"]["lat"].alias("lat"), (F.pmod(lon + k["f"]["east"] + 180, F.lit(360.0)) - 180).alias("lon")))


def along_axes(axes: DataFrame) -> DataFrame:
    """``axes`` (axis_id, seq, lon, lat) with ``metres`` from the axis's first vertex and the ``azimuth`` at which each vertex is reached (at the first: left)."""
    order = Window.partitionBy("axis_id").orderBy("seq")
    before, after = (lambda c: F.lag(c).over(order)), (lambda c: F.lead(c).over(order))
    legs = axes.withColumns({"_plat": before("lat"), "_plon": before("lon"), "_nlat": after("lat"), "_nlon": after("lon")})
    legs = legs.withColumns(
        {"_in": F.when(F.col("_plat").isNotNull(), inverse(F.col("_plat"), F.col("_plon"), F.col("lat"), F.col("lon"))), "_out": inverse(F.col("lat"), F.col("lon"), F.col("_nlat"), F.col("_nlon"))}
    )
    so_far = F.sum(F.coalesce(F.col("_in.metres"), F.lit(0.0))).over(order)
    azimuth = F.when(F.col("_plat").isNotNull(), F.col("_in.azimuth")).otherwise(F.col("_out.azimuth"))
    return legs.select("axis_id", "seq", "lon", "lat", so_far.alias("metres"), azimuth.alias("azimuth"))


def approach_gates(axes: DataFrame, entries: DataFrame, distances_nm: list[float], half_widths_nm: dict[float, float] | None = None) -> DataFrame:
    """A gate across each axis at each distance from its entry: at the vertex nearest to that distance, square to the axis there.

    ``entries`` (axis_id, lon, lat) tell where an axis is entered: at its vertex nearest in degrees. Gates reach
    ``half_widths_nm`` of their distance to either side, else one mile. Of vertices equally near the first counts.
    """
    widths = half_widths_nm or {}
    way = along_axes(axes)
    start = way.join(entries.select("axis_id", F.col("lon").alias("_elon"), F.col("lat").alias("_elat")), "axis_id")
    off = F.struct(F.hypot(F.col("lon") - F.col("_elon"), F.col("lat") - F.col("_elat")), F.col("seq"))
    start = start.groupBy("axis_id").agg(F.min_by("seq", off).alias("_from"), F.min_by("metres", off).alias("_base"))
    wanted = F.array(*[F.struct(F.lit(float(d)).alias("distance_nm"), F.lit(float(widths.get(d, 1.0))).alias("half_width_nm")) for d in distances_nm])
    tried = way.join(start, "axis_id").where(F.col("seq") >= F.col("_from")).withColumn("_w", F.explode(wanted))
    miss = F.struct(F.abs(F.col("metres") - F.col("_base") - F.col("_w.distance_nm") * MILE_M), F.col("seq"))
    at = tried.groupBy("axis_id", F.col("_w.distance_nm").alias("distance_nm"), F.col("_w.half_width_nm").alias("half_width_nm")).agg(F.min_by(F.struct("lon", "lat", "azimuth"), miss).alias("_c"))
    side = lambda turn: direct(F.col("_c.lat"), F.col("_c.lon"), F.col("_c.azimuth") + turn, F.col("half_width_nm") * MILE_M)
    drawn = at.withColumns({"_l": side(-90.0), "_r": side(90.0)})
    name = F.format_string("GATE_%s_%dNM", F.col("axis_id"), F.col("distance_nm").cast("int"))
    return drawn.select(
        name.alias("gate_id"), "axis_id", "distance_nm", "half_width_nm", (2 * F.col("half_width_nm")).alias("width_nm"), F.col("_c.lon").alias("lon"), F.col("_c.lat").alias("lat"), F.col("_c.azimuth").alias("azimuth"),
        F.col("_l.lon").alias("left_lon"), F.col("_l.lat").alias("left_lat"), F.col("_r.lon").alias("right_lon"), F.col("_r.lat").alias("right_lat"),
    )
