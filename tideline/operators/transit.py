"""Transits: pairing of events into journeys, and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.columns import MAD_SCALE, epoch_seconds


def hours_between(a: str, b: str) -> Column:
    return (epoch_seconds(b) - epoch_seconds(a)) / 3600.0


def next_match(events: DataFrame, is_entry: Column, is_exit: Column, max_hours: float = 48.0) -> DataFrame:
    """Each entry with the vessel's first exit after it, at most ``max_hours`` later.

    One window pass over entries and exits takes the place of a lateral join. Rows of equal time lie in one range,
    so an exit at the very time of an entry is not after it.
    """
    ordered = events.where(is_entry | is_exit).withColumn("_t", F.unix_micros(F.col("ts").cast("timestamp")))
    later = Window.partitionBy("mmsi").orderBy("_t").rangeBetween(1, Window.unboundedFollowing)
    nearest = F.min(F.when(is_exit, F.struct(F.col("ts").alias("exit_ts"), F.col("gate_id").alias("to_id")))).over(later)
    found = ordered.withColumn("_x", nearest).where(is_entry & F.col("_x").isNotNull())
    return found.select(
        "mmsi", F.col("gate_id").alias("from_id"), F.col("ts").alias("entry_ts"), F.col("_x.exit_ts"), F.col("_x.to_id"),
        hours_between("ts", "_x.exit_ts").alias("hours"),
    ).where(F.col("hours") <= max_hours)


def transit_stats(transits: DataFrame, by: list[str]) -> DataFrame:
    """Median, mean, discrete 90th percentile and count of hours."""
    return transits.groupBy(*by).agg(
        F.median("hours").alias("median_h"),
        F.avg("hours").alias("mean_h"),
        F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY hours)").alias("p90_h"),
        F.count(F.lit(1)).alias("n"),
    )


def paired_transits(stats: DataFrame, by: list[str]) -> DataFrame:
    """Count-weighted means of means and medians, the largest 90th percentile, and the sum of counts."""
    n = F.sum("n")
    return stats.groupBy(*by).agg(
        (F.sum(F.col("mean_h") * F.col("n")) / F.nullif(n, F.lit(0))).alias("mean_h"),
        (F.sum(F.col("median_h") * F.col("n")) / F.nullif(n, F.lit(0))).alias("median_h"),
        F.max("p90_h").alias("p90_h"),
        n.alias("n"),
    )


def lag_transits(events: DataFrame, first: str, second: str, least: int = 3) -> DataFrame:
    """Statistics of ``first`` directly followed by ``second`` for a vessel, by day; days with fewer than ``least`` go."""
    order = Window.partitionBy("mmsi").orderBy("ts")
    seen = events.withColumn("_e", F.lag("event").over(order)).withColumn("_t", F.lag("ts").over(order))
    pairs = seen.where((F.col("event") == second) & (F.col("_e") == first)).withColumn("hours", hours_between("_t", "ts"))
    return (
        pairs.groupBy(F.to_date("ts").alias("ds"))
        .agg(F.percentile("hours", F.lit(0.5)).alias("p50_h"), F.percentile("hours", F.lit(0.9)).alias("p90_h"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= least)
    )


def rank_pairs(events: DataFrame, enter: str, leave: str) -> DataFrame:
    """The k-th entry of each vessel with its k-th exit, where the exit is later."""
    order = Window.partitionBy("mmsi").orderBy("ts")
    ins = events.where(F.col("event") == enter).select("mmsi", F.col("ts").alias("enter_ts"), F.row_number().over(order).alias("k"))
    outs = events.where(F.col("event") == leave).select("mmsi", F.col("ts").alias("exit_ts"), F.row_number().over(order).alias("k"))
    return ins.join(outs, ["mmsi", "k"]).where("exit_ts > enter_ts")


def interval_join(spans: DataFrame, fixes: DataFrame, least: int = 2) -> DataFrame:
    """Fixes of the same vessel within each span: count and mean speed; spans with fewer than ``least`` go.

    Vessels meet by day, a span once for each day it touches, so that a vessel with many fixes is split.
    """
    at = fixes.select("mmsi", F.to_date("ts").alias("_day"), F.col("ts").alias("_ts"), "sog")
    days = F.explode(F.sequence(F.to_date("enter_ts"), F.to_date("exit_ts"))).alias("_day")
    joined = spans.where("exit_ts >= enter_ts").select("mmsi", "k", "enter_ts", "exit_ts", days).join(at, ["mmsi", "_day"])
    joined = joined.where(F.col("_ts").between(F.col("enter_ts"), F.col("exit_ts")))
    return joined.groupBy("mmsi", "k").agg(F.count(F.lit(1)).alias("n_points"), F.avg("sog").alias("mean_sog")).where(F.col("n_points") >= least)


def lead_pairs(events: DataFrame, most_minutes: float = 2400.0) -> DataFrame:
    """Each event with the vessel's next one, whatever it is, within ``most_minutes``."""
    order = Window.partitionBy("mmsi").orderBy("ts")
    nxt = events.withColumn("to_event", F.lead("event").over(order)).withColumn("to_ts", F.lead("ts").over(order))
    minutes = (epoch_seconds("to_ts") - epoch_seconds("ts")) / 60.0
    return nxt.withColumn("minutes", minutes).where(F.col("minutes").between(0, most_minutes))


def transit_anomalies(pairs: DataFrame, keys: list[str], since: Column, times: float = 3.0) -> DataFrame:
    """Pairs since ``since`` that took longer than median + ``times`` robust deviations of all of their kind."""
    kind = Window.partitionBy(*keys)
    timed = pairs.withColumn("med", F.median("minutes").over(kind))
    timed = timed.withColumn("mad", F.lit(MAD_SCALE) * F.median(F.abs(F.col("minutes") - F.col("med"))).over(kind))
    limit = F.col("med") + times * F.col("mad")
    return timed.withColumn("limit", limit).where((F.col("ts") >= since) & (F.col("minutes") > F.col("limit")))


def baseline_median(daily: DataFrame, as_of: Column, days: int = 30, by: str = "corridor_id") -> DataFrame:
    """Median of daily medians over the days before ``as_of``, which is not one of them."""
    prior = daily.where((F.col("ds") >= F.date_sub(as_of, days)) & (F.col("ds") < as_of))
    return prior.groupBy(by).agg(F.median("median_h").alias("baseline_h"), F.count(F.lit(1)).alias("days"))
