"""View queries: newest rows, anchored series, merged dimensions, and small summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at_latest(rows: DataFrame, ts: str, key: str | None = None) -> DataFrame:
    """Rows at the newest time, of all or of each key."""
    by = Window.partitionBy(key) if key else None
    if by is None:
        newest = rows.agg(F.max(ts).alias("_m"))
        return rows.join(F.broadcast(newest), F.col(ts) == F.col("_m")).drop("_m")
    return rows.withColumn("_m", F.max(ts).over(by)).where(F.col(ts) == F.col("_m")).drop("_m")


def anchored_series(rows: DataFrame, key: str, ts: str, x: str, hours: int) -> DataFrame:
    """Rows of the last ``hours`` before each key's own newest row, with the key's total."""
    by = Window.partitionBy(key)
    recent = rows.withColumn("_m", F.max(ts).over(by)).where(F.col(ts) > F.col("_m") - F.expr(f"INTERVAL {hours} HOURS")).drop("_m")
    return recent.withColumn("total", F.sum(x).over(by))


def newest_first(rows: DataFrame, ts: str, ties: list[str], limit: int = 100) -> DataFrame:
    """The newest rows, between 1 and 500 of them."""
    return rows.orderBy(F.desc(ts), *ties).limit(min(max(limit, 1), 500))


def tail_days(rows: DataFrame, d: str, n: int) -> DataFrame:
    """Rows of the last ``n`` days, counted back from the newest day."""
    newest = rows.agg(F.max(d).alias("_m"))
    return rows.join(F.broadcast(newest), F.col(d) >= F.date_sub("_m", n - 1)).drop("_m")


def latest_known(rows: DataFrame, key: str, d: str, x: str, days: int) -> DataFrame:
    """Each key's value on its newest day among the last ``days``; keys whose newest value is null go."""
    kept = tail_days(rows, d, days)
    return kept.groupBy(key).agg(F.max(d).alias(d), F.max_by(x, d).alias(x)).where(F.col(x).isNotNull())


def flag_union(sources: list[DataFrame], keys: list[str], flag: str) -> DataFrame:
    """Largest flag by key over several sources."""
    rows = sources[0]
    for source in sources[1:]:
        rows = rows.unionByName(source)
    return rows.groupBy(*keys).agg(F.max(flag).alias(flag))


def region_pivot(rows: DataFrame, by: str, region: str, names: list[str], x: str) -> DataFrame:
    """Sums of the named regions as columns, 0 where there is none, and of all."""
    sums = [F.sum(F.when(F.col(region) == n, F.col(x)).otherwise(0)).alias(n.lower().replace(" ", "_")) for n in names]
    return rows.groupBy(by).agg(*sums, F.sum(x).alias("total"))


def corridor_traffic(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """Events and distinct vessels of corridors, of which a polygon may be in several (``mapping``: a small dimension)."""
    spread = mapping.select("polygon_id", F.explode("corridors").alias("corridor_id"))
    return events.join(spread, "polygon_id").groupBy("corridor_id").agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("mmsi").alias("vessels"), F.countDistinct("polygon_id").alias("polygons")
    )


def area_stats(grid: DataFrame, by: list[str], *names: str) -> DataFrame:
    """Mean, 90th and 95th percentile of the values that are numbers."""
    out = []
    for c in names:
        value = F.when(~F.isnan(c), F.col(c))
        out += [F.avg(value).alias(f"{c}_mean"), F.percentile(value, F.lit(0.9)).alias(f"{c}_p90"), F.percentile(value, F.lit(0.95)).alias(f"{c}_p95")]
    return grid.groupBy(*by).agg(*out)


def histogram(rows: DataFrame, x: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins between bounds; values outside fall in the outer bins."""
    number = F.least(F.greatest(F.floor((F.col(x) - low) / ((high - low) / bins)), F.lit(0)), F.lit(bins - 1))
    return rows.where(F.col(x).isNotNull()).groupBy(number.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def distinct_places(rows: DataFrame, lat: str, lon: str, digits: int = 5) -> DataFrame:
    """Places that differ after rounding."""
    return rows.select(F.round(lat, digits).alias("lat"), F.round(lon, digits).alias("lon")).distinct()


def gauge(level: Column, baseline: Column) -> tuple[Column, Column]:
    """Ratio to the baseline in per cent within 0 and 200, and its zone."""
    ratio = F.least(F.greatest(F.try_divide(level, baseline) * 100, F.lit(0.0)), F.lit(200.0))
    zone = F.when(ratio < 80, "low").when(ratio < 120, "normal").when(ratio < 150, "elevated").when(ratio.isNotNull(), "high")
    return ratio, zone


def readiness(rows: DataFrame, d: str, as_of: Column, most_days: int = 2) -> DataFrame:
    """Age in days of the newest row, and whether it is recent enough."""
    return rows.agg(F.max(d).alias("latest")).select(
        "latest", F.datediff(as_of, "latest").alias("age_days"), (F.datediff(as_of, "latest") <= most_days).alias("ready")
    )


def day_opposing(rows: DataFrame) -> DataFrame:
    """The newest row with the mean opposing current of its day."""
    newest = at_latest(rows, "ts").select("ts", "hs", F.to_date("ts").alias("d")).dropDuplicates(["ts"])
    means = rows.groupBy(F.to_date("ts").alias("d")).agg(F.avg("opposing").alias("opposing_mean"))
    return means.join(F.broadcast(newest), "d").select("ts", "hs", "opposing_mean")


def series_of_days(rows: DataFrame, keys: list[str], d: str, days: int) -> DataFrame:
    """Rows of the last ``days`` before each series' own newest day, that day included, with ``latest`` on its rows."""
    by = Window.partitionBy(*keys)
    kept = rows.withColumn("_m", F.max(d).over(by)).where(F.col(d) > F.date_sub("_m", days))
    return kept.withColumn("latest", F.col(d) == F.col("_m")).drop("_m")


def last_rows(rows: DataFrame, keys: list[str], d: str, n: int) -> DataFrame:
    """The last ``n`` rows of each series."""
    order = Window.partitionBy(*keys).orderBy(F.desc(d))
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def busiest_places(visits: DataFrame, as_of: Column, days: int = 7, most: int = 10) -> DataFrame:
    """The places with most visits (polygon_id, kind, mmsi, ts_in, dwell_min) of the last ``days``: visits, hours, vessels."""
    recent = visits.where((F.col("ts_in") >= as_of - F.expr(f"INTERVAL {days} DAYS")) & (F.col("ts_in") <= as_of))
    sums = recent.groupBy("polygon_id", "kind").agg(
        F.count(F.lit(1)).alias("visits"), F.round(F.sum("dwell_min") / 60, 1).alias("dwell_hours"), F.countDistinct("mmsi").alias("vessels")
    )
    return sums.orderBy(F.desc("visits"), "polygon_id", "kind").limit(most)


def recent_visits(visits: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Visits, vessels and minutes of the last ``hours``, in one row."""
    recent = (F.col("ts_in") >= as_of - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("ts_in") <= as_of)
    return visits.agg(
        F.count_if(recent).alias("visits"), F.countDistinct(F.when(recent, F.col("mmsi"))).alias("vessels"), F.coalesce(F.sum(F.when(recent, F.col("dwell_min"))), F.lit(0)).alias("dwell_min")
    )
