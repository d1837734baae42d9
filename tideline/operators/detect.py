"""Anomalies and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.columns import safe_z


def baseline_bundle(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Mean, deviation, median, MAD and outer percentiles of each series."""
    seen = rows.withColumn("_m", F.median(x).over(Window.partitionBy(*keys)))
    return seen.groupBy(*keys).agg(
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.median(x).alias("median"),
        F.median(F.abs(F.col(x) - F.col("_m"))).alias("mad"),
        F.percentile(x, F.lit(0.95)).alias("p95"),
        F.percentile(x, F.lit(0.05)).alias("p05"),
    )


def point_anomalies(rows: DataFrame, keys: list[str], x: str, limit: float = 3.5) -> DataFrame:
    """Values whose modified z, ``0.6745 (x - median) / MAD`` (standard z where MAD is 0), exceeds ``limit``, with severity."""
    joined = rows.join(baseline_bundle(rows, keys, x), keys)
    z = F.when(F.col("mad") > 0, 0.6745 * (F.col(x) - F.col("median")) / F.col("mad")).otherwise(safe_z(F.col(x), F.col("mean"), F.col("std")))
    found = joined.withColumn("z", z).where(F.abs("z") > limit)
    return found.withColumn("severity", F.least(F.lit(1.0), (F.abs("z") - limit) / 5.0)).withColumn(
        "kind", F.when(F.col("z") > 0, "high").otherwise("low")
    )


def series_anomalies(rows: DataFrame, keys: list[str], ts: str, x: str, width: int = 24, least: int = 6, limit: float = 3.0) -> DataFrame:
    """Rows whose z within the last ``width`` rows exceeds ``limit``."""
    frame = Window.partitionBy(*keys).orderBy(ts).rowsBetween(1 - width, 0)
    z = F.when(F.count(x).over(frame) >= least, safe_z(F.col(x), F.avg(x).over(frame), F.stddev_samp(x).over(frame)))
    found = rows.withColumn("z", z).where(F.abs("z") > limit)
    return found.withColumn("severity", F.least(F.lit(1.0), (F.abs("z") - limit) / 3.0))


def long_stays(visits: DataFrame, hours: Column, long: float = 48.0, other: float = 24.0) -> DataFrame:
    """Visits over two thresholds by polygon; the lower one's count includes the higher's."""
    return visits.groupBy("polygon_id").agg(
        F.sum(F.when(hours >= long, 1).otherwise(0)).alias("count_vlcc"), F.sum(F.when(hours >= other, 1).otherwise(0)).alias("count_other")
    )


def route_deviation(shares: DataFrame, jump: float = 0.25, least: int = 10) -> DataFrame:
    """The row of route shares where the recent share exceeds the baseline by ``jump`` with enough crossings."""
    return shares.where((F.col("recent_share") - F.col("baseline_share") >= jump) & (F.col("recent_crossings") >= least))


def robust_spread(rows: DataFrame, by: list[str], x: str) -> DataFrame:
    """Each value with its group's median and MAD; a MAD below 1e-6 is replaced by the larger of 1 and the median."""
    group = Window.partitionBy(*by)
    seen = rows.withColumn("median", F.median(x).over(group))
    mad = F.median(F.abs(F.col(x) - F.col("median"))).over(group)
    return seen.withColumn("_mad", mad).withColumn(
        "spread", F.when(F.col("_mad") < 1e-6, F.greatest(F.lit(1.0), F.col("median"))).otherwise(F.col("_mad"))
    ).drop("_mad")


def stagnant(rows: DataFrame, keys: list[str], d: str, x: str, width: int = 30, least: int = 120) -> DataFrame:
    """Series of at least ``least`` rows that never move within any ``width`` rows."""
    frame = Window.partitionBy(*keys).orderBy(d).rowsBetween(1 - width, 0)
    full = F.when(F.count(x).over(frame) >= width, F.stddev_samp(x).over(frame))
    return rows.withColumn("_s", full).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("_s").alias("most_std")).withColumn(
        "stagnant", (F.col("n") >= least) & (F.coalesce("most_std", F.lit(0.0)) == 0.0)
    )
