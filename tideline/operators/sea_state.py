"""Sea state: components along a course, impact scores, and area statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.columns import KNOTS_PER_MS, along, clip, finite, nan_to_null

MEASURES = ("hc", "hw", "we")
#: Weights of head current, head wind and wave encounter.
WEIGHTS = (0.50, 0.35, 0.15)


def head_components(samples: DataFrame, course_deg: str = "mean_cog") -> DataFrame:
    """Head current in knots, head wind, and wave encounter of samples on a course in degrees."""
    theta = F.radians(F.col(course_deg))
    return samples.withColumns(
        {
            "head_current_kn": along("uo", "vo", theta) * F.lit(KNOTS_PER_MS),
            "head_wind_ms": along("u10", "v10", theta),
            "wave_encounter_m": F.col("hs"),
        }
    )


def circular_mean(course_deg: Column | str) -> Column:
    """Mean course in degrees; nulls don't count."""
    c = F.col(course_deg) if isinstance(course_deg, str) else course_deg
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(F.radians(c))), F.avg(F.cos(F.radians(c))))), F.lit(360.0))


def impact_daily(samples: DataFrame, last_days: int = 7, history_days: int = 730, high: float = 0.7) -> DataFrame:
    """Daily impact scores of each corridor's newest days, each scaled by the percentiles of the days before it.

    A measure is scaled between the 5th and 95th percentile of its corridor's trailing history, the weighted sum goes
    through a logistic, and the day is summed up: mean, 90th percentiles of the score and of the measures, share at
    least ``high``, count. History is counted by day and value first, and joined for the ``last_days`` days only.
    """
    kept = samples.where(finite("hc") & finite("hw") & finite("we"))
    days = kept.select("corridor_id", "ds").distinct()
    order = Window.partitionBy("corridor_id").orderBy(F.desc("ds"))
    targets = days.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= last_days).select("corridor_id", F.col("ds").alias("day"))
    bounds = None
    for m in MEASURES:
        counts = kept.groupBy("corridor_id", "ds", m).agg(F.count(F.lit(1)).alias("_c"))
        past = targets.join(counts, "corridor_id").where((F.col("ds") <= F.col("day")) & (F.col("ds") > F.date_sub("day", history_days)))
        found = past.groupBy("corridor_id", "day").agg(F.percentile(m, F.array(F.lit(0.05), F.lit(0.95)), F.col("_c")).alias(f"{m}_b"))
        bounds = found if bounds is None else bounds.join(found, ["corridor_id", "day"])
    scored = kept.join(bounds, (kept["corridor_id"] == bounds["corridor_id"]) & (kept["ds"] == bounds["day"])).drop(bounds["corridor_id"])
    total = F.lit(0.0)
    for m, w in zip(MEASURES, WEIGHTS):
        low, top = F.get(f"{m}_b", F.lit(0)), F.get(f"{m}_b", F.lit(1))
        total = total + F.lit(w) * F.coalesce(clip(F.when(top > low, (F.col(m) - low) / (top - low)), 0.0, 1.0), F.lit(0.0))
    scored = scored.withColumn("sis", F.lit(1.0) / (F.lit(1.0) + F.exp(-total)))
    return scored.groupBy("ds", "corridor_id").agg(
        F.avg("sis").alias("sis_mean"),
        F.percentile("sis", F.lit(0.9)).alias("sis_p90"),
        *[F.percentile(m, F.lit(0.9)).alias(f"{m}_p90") for m in MEASURES],
        F.avg((F.col("sis") >= high).cast("double")).alias("pct_sis_high"),
        F.count(F.lit(1)).alias("n_samples"),
    )


def region_stats(samples: DataFrame, by: list[str], x: str, vessel: str) -> DataFrame:
    """Mean and 90th percentile of the finite values, distinct vessels, and count."""
    value = nan_to_null(x)
    return samples.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.percentile(value, F.lit(0.9)).alias("p90"), F.countDistinct(vessel).alias("vessels"), F.count(F.lit(1)).alias("n")
    )


def flux_metrics(rows: DataFrame, hs: Column, current_kn: Column, wind_ms: Column, x: str = "flux") -> DataFrame:
    """Of each region its flux against the median of all in units of their median deviation, within 3, a delay factor and a proxy of the impact score.

    Head current and wind count by their size, whatever their sign. Where the deviation is below 1e-6 the median stands
    for it, 1 at least. ``rows`` has one row for each region.
    """
    part = lambda c, most: F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0)) / most)
    proxy = 0.50 * part(hs, 5.0) + 0.35 * part(F.abs(current_kn), 3.5) + 0.15 * part(F.abs(wind_ms), 15.0)
    # two tables of one row
    middle = rows.agg(F.median(F.coalesce(x, F.lit(0))).alias("_m"), F.max(F.coalesce(x, F.lit(0))).alias("_top"))
    with_middle = rows.withColumn("_x", F.coalesce(x, F.lit(0)).cast("double")).crossJoin(F.broadcast(middle))
    spread = with_middle.agg(F.median(F.abs(F.col("_x") - F.col("_m"))).alias("_mad"))
    unit = F.when(F.col("_mad") < 1e-6, F.greatest(F.lit(1.0), F.col("_m"))).otherwise(F.col("_mad"))
    out = with_middle.crossJoin(F.broadcast(spread)).withColumns(
        {
            "z_clipped": clip((F.col("_x") - F.col("_m")) / unit, -3.0, 3.0),
            "delay": F.lit(1.0) + F.least(F.lit(0.5), F.greatest(F.lit(0.0), 0.3 * F.coalesce(F.try_divide("_x", "_top"), F.lit(0.0)))),
            "sis_proxy": F.round(proxy, 3),
        }
    )
    return out.drop("_x", "_m", "_top", "_mad")


def speed_of_means(grid: DataFrame, by: list[str], u: str, v: str, limit: float) -> DataFrame:
    """Speed of the mean vector by group (not the mean of speeds), in knots, and a flag from ``limit`` on."""
    mean = grid.groupBy(*by).agg(F.avg(nan_to_null(u)).alias("u"), F.avg(nan_to_null(v)).alias("v"))
    speed = F.hypot("u", "v") * F.lit(KNOTS_PER_MS)
    return mean.select(*by, speed.alias("speed_kn"), (speed >= limit).alias("flag"))
