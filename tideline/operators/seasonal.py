"""Seasonal baselines, z scores, rolling measures and simple forecasts over daily or hourly series.

Every operator takes the columns that part the series (``keys``) and works on all series at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.columns import clip, safe_z

BANDS = ((-2.5, "far below"), (-1.5, "well below"), (-0.5, "below"), (0.5, "normal"), (1.5, "above"), (2.5, "well above"))


def doy_baseline(daily: DataFrame, keys: list[str], d: str = "d", x: str = "x", days: int = 400) -> DataFrame:
    """Mean, sample deviation and count by day of year over the last ``days`` before each series' newest day.

    The deviation is null with fewer than two values or below 1e-6.
    """
    newest = daily.withColumn("_max", F.max(d).over(Window.partitionBy(*keys)))
    rows = newest.where(F.col(d) > F.date_sub(F.col("_max"), days))
    std = F.stddev_samp(x)
    return rows.groupBy(*keys, F.dayofyear(d).alias("doy")).agg(
        F.avg(x).alias("mean"), F.when(std >= 1e-6, std).alias("std"), F.count(x).alias("n")
    )


def doy_zscore(daily: DataFrame, keys: list[str], d: str = "d", x: str = "x") -> DataFrame:
    """z score against the same day of year; 0 where there is no deviation."""
    same = Window.partitionBy(*keys, F.dayofyear(d))
    std = F.stddev_samp(x).over(same)
    return daily.withColumn("z", F.coalesce(safe_z(F.col(x), F.avg(x).over(same), std), F.lit(0.0)))


def winsorize(rows: DataFrame, keys: list[str], x: str = "x", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """``x`` kept within its series' own percentiles."""
    whole = Window.partitionBy(*keys)
    bounds = F.percentile(x, F.array(F.lit(low), F.lit(high))).over(whole)
    inside = F.greatest(F.least(F.col(x), F.get("_b", F.lit(1))), F.get("_b", F.lit(0)))
    return rows.withColumn("_b", bounds).withColumn(x, F.when(F.col(x).isNotNull(), inside)).drop("_b")


def forward_fill(rows: DataFrame, keys: list[str], d: str, *names: str) -> DataFrame:
    so_far = Window.partitionBy(*keys).orderBy(d).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in names})


def outer_merge(frames: list[DataFrame], on: list[str]) -> DataFrame:
    """Full outer merge of component frames."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.join(frame, on, "full_outer")
    return merged


def changes(rows: DataFrame, keys: list[str], d: str = "d", x: str = "x", steps: tuple[int, ...] = (1, 5)) -> DataFrame:
    """Differences and relative changes over a number of rows."""
    order = Window.partitionBy(*keys).orderBy(d)
    out = {}
    for n in steps:
        before = F.lag(x, n).over(order)
        out[f"diff_{n}"] = F.col(x) - before
        out[f"pct_{n}"] = F.try_divide(F.col(x) - before, before)
    return rows.withColumns(out)


def rolling_z(rows: DataFrame, keys: list[str], d: str = "d", x: str = "x", width: int = 7, least: int | None = None) -> DataFrame:
    """z score within the last ``width`` rows, from ``least`` values on (half the width)."""
    frame = Window.partitionBy(*keys).orderBy(d).rowsBetween(1 - width, 0)
    enough = F.count(x).over(frame) >= (least if least is not None else width // 2)
    return rows.withColumn("z", F.when(enough, safe_z(F.col(x), F.avg(x).over(frame), F.stddev_samp(x).over(frame))))


def rolling_volatility(rows: DataFrame, keys: list[str], d: str = "d", x: str = "x", width: int = 21) -> DataFrame:
    """Sample deviation of the last ``width`` relative changes, once there are so many."""
    order = Window.partitionBy(*keys).orderBy(d)
    moved = rows.withColumn("_r", F.try_divide(F.col(x), F.lag(x).over(order)) - 1)
    frame = order.rowsBetween(1 - width, 0)
    return moved.withColumn("volatility", F.when(F.count("_r").over(frame) >= width, F.stddev_samp("_r").over(frame))).drop("_r")


def rolling_rank(rows: DataFrame, keys: list[str], d: str = "d", x: str = "x", width: int = 365, least: int = 60) -> DataFrame:
    """Percentage of the last ``width`` values that are at most the current one."""
    frame = Window.partitionBy(*keys).orderBy(d).rowsBetween(1 - width, 0)
    seen = F.collect_list(x).over(frame)
    rank = F.size(F.filter("_s", lambda v: v <= F.col(x))) / F.size("_s") * 100
    return rows.withColumn("_s", seen).withColumn("pct_rank", F.when((F.size("_s") >= least) & F.col(x).isNotNull(), rank)).drop("_s")


def mid_rank(rows: DataFrame, keys: list[str], d: str = "d", x: str = "x", width: int = 70) -> DataFrame:
    """Mid-rank of the current value in the last ``width``: less + half of equal (within 1e-9), over the count."""
    frame = Window.partitionBy(*keys).orderBy(d).rowsBetween(1 - width, 0)
    same = lambda v: F.abs(v - F.col(x)) <= 1e-9
    less = F.size(F.filter("_s", lambda v: (v < F.col(x)) & ~same(v)))
    equal = F.size(F.filter("_s", same))
    return rows.withColumn("_s", F.collect_list(x).over(frame)).withColumn("mid_rank", (less + 0.5 * equal) / F.size("_s")).drop("_s")


def time_rolling(rows: DataFrame, keys: list[str], ts: str, x: str, days: int) -> DataFrame:
    """Mean, sample deviation and sum over the time range ``(t - days, t]``."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    frame = Window.partitionBy(*keys).orderBy(at).rangeBetween(1 - days * 86_400_000_000, 0)
    return rows.withColumns(
        {"roll_mean": F.avg(x).over(frame), "roll_std": F.stddev_samp(x).over(frame), "roll_sum": F.sum(x).over(frame)}
    )


def forward_target(rows: DataFrame, keys: list[str], d: str = "d", x: str = "x", ahead: int = 1, width: int = 30) -> DataFrame:
    """Change ``ahead`` rows on, and whether it exceeds half the rolling deviation (the first known one before there is any)."""
    order = Window.partitionBy(*keys).orderBy(d)
    limit = 0.5 * F.stddev_samp(x).over(order.rowsBetween(1 - width, 0))
    seen = rows.withColumn("change", F.lead(x, ahead).over(order) - F.col(x)).withColumn("_l", limit)
    filled = F.first("_l", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return seen.withColumn("threshold", filled).withColumn("target", F.when(F.col("change").isNotNull(), (F.col("change") > F.col("threshold")).cast("int"))).drop("_l")


def day_delta(rows: DataFrame, keys: list[str], d: str = "d", x: str = "x") -> DataFrame:
    before = F.lag(x).over(Window.partitionBy(*keys).orderBy(d))
    return rows.withColumn("delta", F.col(x) - before).withColumn("delta_pct", F.try_divide(F.col(x) - before, before) * 100)


def ordered_values(rows: DataFrame, keys: list[str], d: str, x: str) -> DataFrame:
    """The values of each series in order, as one array (series of a bounded number of steps)."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(d).alias("d"), F.col(x).cast("double").alias("x"))))
    return rows.groupBy(*keys).agg(F.transform(pairs, lambda p: p["x"]).alias("xs"), F.max(d).alias("last"))


def ema(rows: DataFrame, keys: list[str], d: str = "d", x: str = "x", span: int = 7) -> DataFrame:
    """Last exponential mean of each series, weighted 2 / (span + 1), started at its first value."""
    a = 2.0 / (span + 1)
    smooth = F.aggregate(F.slice("xs", 2, F.greatest(F.size("xs") - 1, F.lit(0))), F.get("xs", F.lit(0)), lambda m, v: m + a * (v - m))
    return ordered_values(rows, keys, d, x).withColumn("ema", smooth).drop("xs")


def ema_forecast(rows: DataFrame, keys: list[str], horizon: int = 14, d: str = "d", x: str = "x") -> DataFrame:
    """Flat persistence of the mean, with a band of 10 that widens by a fifth, kept within 0 and 200."""
    steps = ema(rows, keys, d, x).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    band = 10.0 * (1.0 + 0.2 * F.col("h") / horizon)
    return steps.select(
        *keys, F.date_add("last", F.col("h")).alias("d"), F.col("ema").alias("forecast"),
        clip(F.col("ema") - band, 0.0, 200.0).alias("low"), clip(F.col("ema") + band, 0.0, 200.0).alias("high"),
    )


def holt(rows: DataFrame, keys: list[str], d: str = "d", x: str = "x", alpha: float = 0.3, horizon: int = 6) -> DataFrame:
    """Level and trend of each series, both smoothed by ``alpha``, and forecasts with a 95 % band of ``1.96 sigma sqrt(h)``.

    The level starts at the first value and the trend at 0. Forecast and lower bound are floored at 0. Residuals are of
    one-step forecasts, of every value but the first; sigma is their population deviation, 0 without any.
    """
    first = F.get("xs", F.lit(0))
    start = F.struct(first.alias("level"), F.lit(0.0).alias("trend"), F.lit(0.0).alias("s"), F.lit(0.0).alias("ss"), F.lit(0.0).alias("n"))

    def step(state: Column, v: Column) -> Column:
        ahead = state["level"] + state["trend"]
        level = alpha * v + (1 - alpha) * ahead
        trend = alpha * (level - state["level"]) + (1 - alpha) * state["trend"]
        off = v - ahead
        return F.struct(
            level.alias("level"), trend.alias("trend"), (state["s"] + off).alias("s"), (state["ss"] + off * off).alias("ss"), (state["n"] + 1.0).alias("n")
        )

    rest = F.slice("xs", 2, F.greatest(F.size("xs") - 1, F.lit(0)))
    fitted = ordered_values(rows, keys, d, x).where(F.size("xs") > 0).withColumn("f", F.aggregate(rest, start, step))
    mean = F.try_divide("f.s", "f.n")
    sigma = F.coalesce(F.sqrt(F.greatest(F.try_divide("f.ss", "f.n") - mean * mean, F.lit(0.0))), F.lit(0.0))
    steps = fitted.withColumn("sigma", sigma).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    point = F.col("f.level") + F.col("h") * F.col("f.trend")
    band = 1.96 * F.col("sigma") * F.sqrt(F.col("h").cast("double"))
    floor = lambda c: F.greatest(c, F.lit(0.0))
    return steps.select(*keys, "h", floor(point).alias("forecast"), floor(point - band).alias("low"), (point + band).alias("high"))


def band_of(z: Column) -> Column:
    """Name of the band of a z score: seven bands, at 0.5, 1.5 and 2.5 on either side."""
    out = None
    for limit, name in BANDS:
        out = F.when(z < limit, name) if out is None else out.when(z < limit, name)
    return F.when(z.isNotNull(), out.otherwise("far above"))


def relative_stress(daily: DataFrame, keys: list[str], d: str = "d", x: str = "x") -> DataFrame:
    """Seasonal mean and deviation, z, deviation in per cent and band of each day."""
    same = Window.partitionBy(*keys, F.dayofyear(d))
    seen = daily.withColumn("mean", F.avg(x).over(same)).withColumn("std", F.stddev_samp(x).over(same))
    seen = seen.withColumn("z", safe_z(x, "mean", "std"))
    return seen.withColumn("deviation_pct", F.try_divide(F.col(x) - F.col("mean"), F.col("mean")) * 100).withColumn("class", band_of(F.col("z")))


def component_bands(daily: DataFrame, baseline: DataFrame, keys: list[str], d: str = "d", x: str = "x") -> DataFrame:
    """Days beside their baseline (a dimension of days of year), with bands of one and two deviations floored at 0."""
    joined = daily.withColumn("doy", F.dayofyear(d)).join(baseline, [*keys, "doy"], "left")
    out = {}
    for n in (1, 2):
        out[f"low_{n}"] = F.when(F.col("std").isNotNull(), F.greatest(F.col("mean") - n * F.col("std"), F.lit(0.0)))
        out[f"high_{n}"] = F.col("mean") + n * F.col("std")
    return joined.withColumns(out).withColumn("deviation_pct", F.try_divide(F.col(x) - F.col("mean"), F.col("mean")) * 100)


def fill_dates(daily: DataFrame, keys: list[str], d: str = "d") -> DataFrame:
    """A row for every day between each series' first and last; made days have nulls in the other columns.

    Each row goes with the days up to the series' next one, so only the given rows are shuffled. A day given by several
    rows keeps them all, rows without a day give none, and a null key is a series of its own.
    """
    rest = [c for c in daily.columns if c not in (*keys, d)]
    following = F.lead(d).over(Window.partitionBy(*keys).orderBy(d))
    # of rows of one day only the last goes on
    upto = F.greatest(F.col(d), F.date_sub("_next", 1))
    days = daily.where(F.col(d).isNotNull()).withColumn("_next", following).withColumn("_d", F.explode(F.sequence(F.col(d), upto)))
    given = F.col("_d") == F.col(d)
    return days.select(*keys, F.col("_d").alias(d), *[F.when(given, F.col(c)).alias(c) for c in rest])
