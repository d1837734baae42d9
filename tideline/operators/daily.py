"""Daily sums and means of sources, joins of their parts, and drift between two stretches of a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.columns import KNOTS_PER_MS, clip, epoch_seconds, nan_to_null
from tideline.operators import seasonal


def dwell_daily(windows: DataFrame) -> DataFrame:
    """Slow vessels summed, and windows counted, by region and day of dwell windows (window_start, region, slow_count)."""
    return windows.groupBy(F.to_date("window_start").alias("d"), "region").agg(F.sum("slow_count").alias("slow_sum"), F.count(F.lit(1)).alias("windows"))


def proxy_component(windows: DataFrame, region: str) -> DataFrame:
    """A region's daily dwell as a component: its z score by day of year, kept within the first and last percentiles of those scores."""
    rows = dwell_daily(windows).where(F.col("region") == region).select("d", "region", F.col("slow_sum").cast("double").alias("x"))
    return seasonal.winsorize(seasonal.doy_zscore(rows, ["region"]), ["region"], "z")


def daily_means(rows: DataFrame, ts: str, by: list[str], *names: str) -> DataFrame:
    """Means of the values that are numbers, by day, and the newest time of each."""
    means = [F.avg(nan_to_null(c)).alias(f"{c}_mean") for c in names]
    return rows.groupBy(F.to_date(ts).alias("d"), *by).agg(*means, F.max(ts).alias("latest"))


def conditional_sums(rows: DataFrame, ts: str, kind: str, x: str, names: list[str]) -> DataFrame:
    """Sums of the named kinds as columns, 0 where there is none, by day."""
    sums = [F.sum(F.when(F.lower(kind) == n, F.col(x)).otherwise(0)).alias(n.replace("-", "_").replace(" ", "_")) for n in names]
    return rows.groupBy(F.to_date(ts).alias("d")).agg(*sums)


def mean_of_sources(frames: list[DataFrame], on: str, x: str) -> DataFrame:
    """Mean over sources by date; sources without a value don't count."""
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.unionByName(frame)
    return rows.groupBy(on).agg(F.avg(nan_to_null(x)).alias(x), F.count(nan_to_null(x)).alias("sources"))


def corridor_weather(rows: DataFrame, ts: str, by: str, u: str, v: str) -> DataFrame:
    """Daily mean speed in knots of the vectors of each corridor, and their number."""
    speed = F.hypot(nan_to_null(u), nan_to_null(v)) * KNOTS_PER_MS
    return rows.groupBy(F.to_date(ts).alias("d"), by).agg(F.avg(speed).alias("speed_kn"), F.count(speed).alias("n"))


def event_flux(events: DataFrame, gate: str = "gate_id", ts: str = "ts") -> DataFrame:
    """Events by gate and day as flux of unknown direction."""
    return events.groupBy(F.to_date(ts).alias("ds"), gate).agg(F.count(F.lit(1)).alias("crossings")).withColumn("direction", F.lit("UNK"))


def crossings_with_fixes(crossings: DataFrame, fixes: DataFrame) -> DataFrame:
    """Crossings with the fix of the same vessel and time, where there is one (mmsi, ts)."""
    return crossings.join(fixes, ["mmsi", "ts"], "left")


def samples_of_tracklets(samples: DataFrame, tracklets: DataFrame, by: list[str]) -> DataFrame:
    """Samples aggregated by fields of their tracklets: mean, 90th percentile and count of the finite scores."""
    value = nan_to_null("score")
    return samples.join(tracklets, "tracklet_id").groupBy(*by).agg(
        F.avg(value).alias("mean"), F.percentile(value, F.lit(0.9)).alias("p90"), F.count(value).alias("n")
    )


def features_with_market(features: DataFrame, market: DataFrame, on: str = "d") -> DataFrame:
    """Days that both have."""
    return features.join(market, on)


def health_measures(width_s: int, bucket_s: int, ts: str) -> list[Column]:
    """Messages, tanker share, share of the window's buckets of ``bucket_s`` without a message, and of implausible fixes.

    A set has at most as many buckets as a window, so the measures also run on streams.
    """
    expected = max(1, width_s // bucket_s)
    seen = F.size(F.collect_set(F.floor(epoch_seconds(ts) / bucket_s)))
    return [
        F.count(F.lit(1)).alias("messages"), F.avg(F.col("is_tanker").cast("int")).alias("tanker_share"),
        (F.lit(1.0) - F.least(seen, F.lit(expected)) / expected).alias("gap_ratio"), F.avg(F.col("spoof").cast("int")).alias("spoof_share"),
    ]


def health_windows(fixes: DataFrame, width_s: int = 600, bucket_s: int = 60, ts: str = "msg_time") -> DataFrame:
    """By window: messages, vessels, tanker share, share of the downsampling buckets that saw no message, share of implausible fixes (``spoof``)."""
    measures = health_measures(width_s, bucket_s, ts)
    return fixes.groupBy(F.window(ts, f"{width_s} seconds").alias("w")).agg(*measures, F.countDistinct("mmsi").alias("vessels")).select(
        F.col("w.start").alias("window_start"), "messages", "vessels", "tanker_share", "gap_ratio", "spoof_share"
    )


def base_rate_shift(rows: DataFrame, d: str, label: str, as_of: Column, days: int = 30) -> DataFrame:
    """Share of positive labels before and within the last ``days``, and how far it moved."""
    late = F.col(d) > F.date_sub(as_of, days)
    rate = lambda when: F.avg(F.when(when, F.col(label).cast("double")))
    return rows.agg(rate(~late).alias("base_rate"), rate(late).alias("recent_rate")).withColumn("shift", F.abs(F.col("recent_rate") - F.col("base_rate")))


def momentum_probability(rows: DataFrame, keys: list[str], d: str, x: str, most_volatile: float | None = None, width: int = 21) -> DataFrame:
    """What stands for a model that has drifted: at the end of each series ``p`` with ``r7, r21, vol21`` and ``reason``.

    The change over 7 rows less half of that over 21, in units of the deviation of ``width`` returns (kept within the
    series' percentiles), through a hyperbolic tangent, within 0.35 and 0.65. One half where the history is short, or
    the deviation above ``most_volatile``.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy(d)
    change = lambda n: F.coalesce(F.try_divide(F.col(x) - F.lag(x, n).over(order), F.lag(x, n).over(order)), F.lit(0.0))
    moved = seasonal.rolling_volatility(rows, keys, d, x, width).withColumns({"_r7": change(6), "_r21": change(20)})
    end = moved.groupBy(*keys).agg(
        F.max_by(F.struct("_r7", "_r21"), d).alias("_e"), F.max_by("volatility", F.when(F.col("volatility").isNotNull(), F.col(d))).alias("_v"),
        F.percentile("volatility", F.array(F.lit(0.01), F.lit(0.99))).alias("_b"), F.count(F.lit(1)).alias("_n"), F.count(x).alias("_support"),
    )
    vol, short = F.greatest(F.least("_v", F.get("_b", F.lit(1))), F.get("_b", F.lit(0))), F.col("_n") < width + 1
    out = end.select(*keys, F.when(short, 0.0).otherwise(F.col("_e._r7")).alias("r7"), F.when(short, 0.0).otherwise(F.col("_e._r21")).alias("r21"), F.when(~short, vol).alias("vol21"), "_support", "_n")
    wild = F.col("vol21") > F.lit(most_volatile).cast("double")
    reason = F.when(F.col("_n") < width + 1, "insufficient_history").when(wild, "high_volatility").when(F.col("_support") < 21, "low_support")
    unit = F.when(F.col("vol21") > 0, F.col("vol21")).otherwise(1e-6)
    p = clip(0.5 + 0.5 * F.tanh((F.col("r7") - 0.5 * F.col("r21")) / unit * 3.0), 0.35, 0.65)
    return out.withColumn("reason", reason).withColumn("p", F.when(F.col("reason").isNotNull(), 0.5).otherwise(p)).drop("_support", "_n")


def contract(rows: DataFrame, d: str, bounded: list[str], low: float = -8.0, high: float = 8.0, least: int = 120, width: int = 30) -> DataFrame:
    """One row that tells whether a component matrix may be published: bounds kept, no date twice, no series at a standstill.

    A series stands still where no deviation over ``width`` rows (ten at least) is above 0; shorter matrices than ``least`` rows pass.
    """
    from pyspark.sql import Window

    # one row for each day of a matrix
    frame = Window.orderBy(d).rowsBetween(1 - width, 0)
    moves = {f"_{c}": F.when(F.count(c).over(frame) >= 10, F.stddev_samp(c).over(frame)) for c in bounded}
    outside = sum(F.when(~F.col(c).between(low, high), 1).otherwise(0) for c in bounded)
    still = sum(F.when(F.max(f"_{c}") == 0, 1).otherwise(0) for c in bounded)
    return rows.withColumns(moves).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(outside).alias("outside"), (F.count(F.lit(1)) - F.countDistinct(d)).alias("repeated_dates"),
        F.when(F.count(F.lit(1)) >= least, still).otherwise(0).alias("standing_still"),
    ).withColumn("valid", (F.col("outside") == 0) & (F.col("repeated_dates") == 0) & (F.col("standing_still") == 0))


def spread_dataset(rows: DataFrame, keys: list[str], d: str, x: str, spread: str, threshold: float = 0.0005) -> DataFrame:
    """Features known at each day, and whether the spread rises by more than ``threshold`` on the next.

    Lags, changes and rolling z scores of ``x``, calendar, and returns of the spread; what is unknown counts as 0. The
    last day of a series has no next and counts as no rise.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy(d)
    out = {}
    for n in (1, 3, 5):
        out[f"lag_{n}"] = F.lag(x, n).over(order)
        out[f"chg_{n}"] = F.col(x) - F.lag(x, n).over(order)
    for n in (7, 14):
        frame = order.rowsBetween(1 - n, 0)
        spread_of = F.stddev_samp(x).over(frame)
        out[f"z_{n}"] = F.when((F.count(x).over(frame) >= n // 2) & (spread_of != 0), (F.col(x) - F.avg(x).over(frame)) / spread_of)
    for n in (1, 5):
        before = F.lag(spread, n).over(order)
        out[f"spread_ret_{n}"] = F.try_divide(F.col(spread) - before, before)
    angle = F.dayofyear(d) * F.lit(2 * 3.141592653589793 / 365.25)
    weekday = F.weekday(d)
    calendar = {"weekday": weekday, "is_mon": (weekday == 0).cast("int"), "is_fri": (weekday == 4).cast("int"), "month": F.month(d), "week": F.weekofyear(d), "doy_sin": F.sin(angle), "doy_cos": F.cos(angle)}
    rise = F.lead(spread).over(order) - F.col(spread)
    target = F.coalesce((rise > threshold).cast("int"), F.lit(0))
    return rows.withColumns({c: F.coalesce(e, F.lit(0.0)) for c, e in out.items()} | calendar | {"target": target})


def telling_components(rows: DataFrame, names: list[str], least: int = 30) -> list[str]:
    """Those of the named columns with at least ``least`` values that aren't all the same, in one pass."""
    found = rows.agg(*[F.struct(F.count(nan_to_null(c)).alias("n"), F.stddev_samp(nan_to_null(c)).alias("s")).alias(f"_{i}") for i, c in enumerate(names)]).first()
    return [c for c, v in zip(names, found) if v.n >= least and v.s]


def sea_state_component(samples: DataFrame, keys: list[str], ts: str, hs: str, u: str, v: str, course_rad: float) -> DataFrame:
    """Daily mean wave height as a seasonal z score, with the mean current against a fixed course."""
    from tideline.functions.columns import along

    by_day = samples.groupBy(F.to_date(ts).alias("d"), *keys).agg(
        F.avg(nan_to_null(hs)).alias("x"), F.avg(along(nan_to_null(u), nan_to_null(v), F.lit(course_rad))).alias("opposing")
    )
    return seasonal.doy_zscore(by_day, keys)
