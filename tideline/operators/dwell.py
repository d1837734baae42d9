"""Dwell, occupancy and visits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.columns import epoch_seconds


def latest_per_minute(fixes: DataFrame, vessel: str = "mmsi", ts: str = "msg_time", tie: str = "rx_time") -> DataFrame:
    """The last message of each vessel and minute, the later received of equals."""
    order = Window.partitionBy(vessel, F.date_trunc("minute", ts)).orderBy(F.desc(ts), F.desc(tie))
    return fixes.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def dwell_windows(fixes: DataFrame, slow: Column, width: str = "10 minutes", ts: str = "msg_time") -> DataFrame:
    """Distinct slow vessels by tumbling window and region; windows with traffic only, 0 where none was slow."""
    return (
        fixes.groupBy(F.window(ts, width).alias("w"), "region")
        .agg(F.countDistinct(F.when(slow, F.col("mmsi"))).alias("slow_count"))
        .select(F.col("w.start").alias("window_start"), "region", "slow_count")
    )


def recent(rows: DataFrame, ts: str, low: Column, high: Column) -> DataFrame:
    """Half-open recency window: ``low < ts <= high``."""
    return rows.where((F.col(ts) > low) & (F.col(ts) <= high))


def occupancy_now(presence: DataFrame, as_of: Column, minutes: int = 30) -> DataFrame:
    """Vessels inside each polygon that were seen within ``minutes`` of ``as_of``."""
    seen = F.col("last_seen_ts") >= as_of - F.expr(f"INTERVAL {minutes} MINUTES")
    return presence.where(F.col("inside") & seen).groupBy("polygon_id").agg(F.count(F.lit(1)).alias("count_now"))


def daily_entries(presence: DataFrame) -> DataFrame:
    return presence.groupBy(F.to_date("enter_ts").alias("ds"), "polygon_id").agg(F.count(F.lit(1)).alias("entries"))


def daily_dwell(visits: DataFrame, slow_below: float = 1.0) -> DataFrame:
    """Dwell hours of closed slow visits by exit day: median, discrete 90th percentile, count."""
    speed = F.coalesce("sog_avg", "sog_max", "sog_min", F.lit(0.0))
    hours = (epoch_seconds("exit_ts") - epoch_seconds("enter_ts")) / 3600.0
    closed = visits.where(F.col("exit_ts").isNotNull() & (speed <= slow_below)).withColumn("h", hours)
    return closed.groupBy(F.to_date("exit_ts").alias("ds"), "polygon_id").agg(
        F.median("h").alias("p50_h"),
        F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY h)").alias("p90_h"),
        F.count(F.lit(1)).alias("n"),
    )


def gap_sessions(fixes: DataFrame, keys: list[str], ts: str = "ts", gap: str = "2 hours", least_minutes: float = 60.0) -> DataFrame:
    """Runs of rows no further apart than ``gap``, of at least ``least_minutes`` from first to last."""
    runs = fixes.groupBy(*keys, F.session_window(ts, gap).alias("s")).agg(
        F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count(F.lit(1)).alias("n")
    )
    minutes = (epoch_seconds("end_ts") - epoch_seconds("start_ts")) / 60.0
    return runs.withColumn("minutes", minutes).where(F.col("minutes") >= least_minutes).drop("s")


def visits_daily(visits: DataFrame) -> DataFrame:
    """Visits, distinct vessels and dwell minutes by day and polygon."""
    return visits.groupBy(F.to_date("ts_in").alias("ds"), "polygon_id").agg(
        F.count(F.lit(1)).alias("visits"), F.countDistinct("mmsi").alias("vessels"), F.sum("dwell_min").alias("dwell_min")
    )


def hourly_vessels(events: DataFrame) -> DataFrame:
    """Distinct vessels by hour and polygon."""
    return events.groupBy(F.date_trunc("hour", "ts").alias("hour"), "polygon_id").agg(F.countDistinct("mmsi").alias("vessels"))


def anchorage_now(events: DataFrame) -> DataFrame:
    """Vessels whose last event is an entry, by polygon, with hours since."""
    order = Window.partitionBy("mmsi", "polygon_id").orderBy(F.desc("ts"))
    last = events.withColumn("_n", F.row_number().over(order)).where("_n = 1 AND event = 'enter'")
    return last.groupBy("polygon_id").agg(F.count(F.lit(1)).alias("vessels"), F.min("ts").alias("longest_since"))
