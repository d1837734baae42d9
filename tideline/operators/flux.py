"""Gate flux: counts, de-duplication, baselines and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.columns import epoch_seconds


def hourly_flux(crossings: DataFrame) -> DataFrame:
    return crossings.groupBy(F.date_trunc("hour", "ts").alias("ts"), "gate_id", "direction").agg(
        F.count(F.lit(1)).alias("crossings")
    )


def daily_flux(crossings: DataFrame) -> DataFrame:
    return crossings.groupBy(F.to_date("ts").alias("ds"), "gate_id", "direction").agg(F.count(F.lit(1)).alias("crossings"))


def rolling_flux(crossings: DataFrame, as_of: Column) -> DataFrame:
    """Crossings of the last day and week, in one pass."""
    day, week = F.col("ts") > as_of - F.expr("INTERVAL 1 DAY"), F.col("ts") > as_of - F.expr("INTERVAL 7 DAYS")
    sums = crossings.where(week & (F.col("ts") <= as_of)).groupBy("gate_id", "direction").agg(
        F.count(F.when(day, 1)).alias("d1"), F.count(F.lit(1)).alias("d7")
    )
    spread = F.explode(F.array(F.struct(F.lit("24h").alias("l"), F.col("d1").alias("n")), F.struct(F.lit("7d").alias("l"), F.col("d7").alias("n"))))
    return sums.select("gate_id", "direction", spread.alias("x")).select(
        F.col("x.l").alias("window_label"), "gate_id", "direction", F.col("x.n").alias("crossings")
    ).where("crossings > 0")


def canonical_gates(gates: DataFrame) -> DataFrame:
    """Of each gate's bands (``..._10NM``) the widest; ``gate_id`` breaks ties."""
    base = F.regexp_replace("gate_id", r"_[0-9]+NM$", "")
    band = F.regexp_extract("gate_id", r"_([0-9]+)NM$", 1).try_cast("int")
    order = Window.partitionBy("base").orderBy(F.desc("band"), "gate_id")
    ranked = gates.select("gate_id").distinct().select("gate_id", base.alias("base"), band.alias("band"))
    return ranked.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("gate_id", "base")


def deduplicated_flux(crossings: DataFrame, rehit: DataFrame, default_hours: float = 6.0) -> DataFrame:
    """Daily crossings of canonical gates, a vessel once for each re-hit bucket; distinct vessels beside.

    Buckets are aligned to the epoch and cut at day boundaries. ``rehit`` (a small dimension) overrides hours by gate.
    """
    kept = crossings.join(canonical_gates(crossings), "gate_id", "left_semi")
    hours = F.coalesce("rehit_hours", F.lit(default_hours))
    bucketed = kept.join(rehit, "gate_id", "left").select(
        F.to_date("ts").alias("ds"),
        "gate_id",
        "direction",
        "mmsi",
        F.floor(epoch_seconds("ts") / (hours * 3600.0)).alias("bucket"),
    )
    once = bucketed.groupBy("ds", "gate_id", "direction", "mmsi").agg(F.countDistinct("bucket").alias("n"))
    return once.groupBy("ds", "gate_id", "direction").agg(
        F.sum("n").alias("crossings"), F.count(F.lit(1)).alias("distinct_vessels")
    )


def gate_baseline(daily: DataFrame, value: str = "crossings") -> DataFrame:
    """Mean, population deviation (0 for one row) and the last seven values in date order."""
    trend = F.slice(F.transform(F.sort_array(F.collect_list(F.struct("ds", value))), lambda x: x[value]), -7, 7)
    last = F.when(F.count(F.lit(1)) >= 7, trend).otherwise(
        F.transform(F.sort_array(F.collect_list(F.struct("ds", value))), lambda x: x[value])
    )
    return daily.groupBy("gate_id").agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), last.alias("trend")
    )


def hour_share(events: DataFrame, quantile: float = 0.9) -> DataFrame:
    """Share of each hour of day in its gate's events, and whether it reaches the gate's own quantile of shares."""
    counts = events.groupBy("gate_id", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    gate = Window.partitionBy("gate_id")
    share = counts.withColumn("share", F.col("n") / F.sum("n").over(gate))
    return share.withColumn("cut", F.percentile("share", F.lit(quantile)).over(gate)).withColumn("peak", F.col("share") >= F.col("cut"))


def route_share(daily: DataFrame, gate: str, other: str, as_of: Column, recent_days: int = 3, baseline_days: int = 15) -> DataFrame:
    """Share of ``gate`` among two gates, in the last days and in the days before them, in one pass."""
    start = F.date_sub(as_of, recent_days)
    before = F.date_sub(as_of, recent_days + baseline_days)
    late = F.col("ds") > start
    early = (F.col("ds") <= start) & (F.col("ds") > before)

    def total(when: Column, g: str) -> Column:
        return F.sum(F.when(when & (F.col("gate_id") == g), F.col("crossings")).otherwise(0))

    sums = daily.where(F.col("gate_id").isin(gate, other)).agg(
        total(late, gate).alias("a"), total(late, other).alias("b"), total(early, gate).alias("c"), total(early, other).alias("d")
    )
    return sums.select(
        F.col("a").alias("recent_crossings"),
        F.try_divide("a", F.col("a") + F.col("b")).alias("recent_share"),
        F.try_divide("c", F.col("c") + F.col("d")).alias("baseline_share"),
    )


def chokepoint_summary(hourly: DataFrame, daily_base: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Flux of the last hours against daily baselines: z score and ratio."""
    recent = hourly.where((F.col("ts") > as_of - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("ts") <= as_of))
    flux = recent.groupBy("gate_id").agg(F.sum("crossings").alias("flux"))
    return flux.join(daily_base, "gate_id", "left").select(
        "gate_id",
        "flux",
        "mean",
        "std",
        F.when(F.col("std") > 0, (F.col("flux") - F.col("mean")) / F.col("std")).alias("z"),
        F.try_divide(F.col("flux"), F.col("mean")).alias("ratio"),
    )
