"""Queries on daily and hourly series: seasonality, indices, anomalies, forecasts, impact scores.

Orders and lines give multi-year daily series: a market segment, priority or region is the series, an order's total
its value; ``events`` give hourly ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.tables import table
from tideline.operators import detect, indices, sea_state, seasonal
from tideline.plans.flow_queries import moves, rounded
from tideline.plans.registry import query

DAILY = """
    day AS (
        SELECT CAST(o_orderdate AS DATE) AS d, o_orderpriority AS k, round(sum(o_totalprice), 2) AS x, count(*) AS n FROM orders GROUP BY ALL
    )
"""
HOURLY = """
    hr AS (SELECT date_trunc('hour', ts) AS ts, event_type AS k, count(DISTINCT user_id) AS x FROM events GROUP BY ALL)
"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``d, k, x, n``: order totals and counts by day and priority."""
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d"), F.col("o_orderpriority").alias("k")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("x"), F.count(F.lit(1)).alias("n")
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ts, k, x``: distinct users by hour and type."""
    return moves(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").alias("ts"), F.col("event").alias("k")).agg(F.countDistinct("mmsi").alias("x"))


@query(
    "doy_baseline",
    f"""
    WITH {DAILY}, m AS (SELECT *, max(d) OVER (PARTITION BY k) AS top FROM day),
    r AS (SELECT * FROM m WHERE d > top - 400)
    SELECT k, CAST(dayofyear(d) AS INT) AS doy, round(avg(x), 3) AS mean,
           round(CASE WHEN stddev_samp(x) >= 1e-6 THEN stddev_samp(x) END, 3) AS std, count(x) AS n FROM r GROUP BY ALL
    """,
)
def doy_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(seasonal.doy_baseline(daily(spark, sf_dir), ["k"]), "mean", "std", digits=3)


@query(
    "doy_zscore",
    f"""
    WITH {DAILY}, s AS (SELECT *, avg(x) OVER w AS m, stddev_samp(x) OVER w AS sd FROM day WINDOW w AS (PARTITION BY k, dayofyear(d)))
    SELECT d, k, x, n, round(coalesce(CASE WHEN sd <> 0 THEN (x - m) / sd END, 0), 6) AS z FROM s
    """,
)
def doy_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(seasonal.doy_zscore(daily(spark, sf_dir), ["k"]), "z")


@query(
    "winsorize",
    f"""
    WITH {DAILY}, b AS (SELECT *, quantile_cont(x, 0.01) OVER (PARTITION BY k) AS lo, quantile_cont(x, 0.99) OVER (PARTITION BY k) AS hi FROM day)
    SELECT d, k, round(greatest(least(x, hi), lo), 3) AS x, n FROM b
    """,
)
def winsorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(seasonal.winsorize(daily(spark, sf_dir), ["k"]), "x", digits=3)


@query(
    "ffill_outer",
    """
    WITH a AS (SELECT CAST(o_orderdate AS DATE) AS d, round(sum(o_totalprice), 2) AS urgent FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
    b AS (SELECT CAST(o_orderdate AS DATE) AS d, round(sum(o_totalprice), 2) AS low FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1),
    m AS (SELECT coalesce(a.d, b.d) AS d, urgent, low FROM a FULL JOIN b ON a.d = b.d)
    SELECT d, last_value(urgent IGNORE NULLS) OVER w AS urgent, last_value(low IGNORE NULLS) OVER w AS low
    FROM m WINDOW w AS (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    """,
)
def ffill_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = daily(spark, sf_dir)
    parts = [rows.where(F.col("k") == k).select("d", F.col("x").alias(name)) for k, name in (("1-URGENT", "urgent"), ("5-LOW", "low"))]
    merged = seasonal.outer_merge(parts, ["d"]).withColumn("_one", F.lit(0))
    return seasonal.forward_fill(merged, ["_one"], "d", "urgent", "low").drop("_one")


@query(
    "macro_lags",
    f"""
    WITH {DAILY} SELECT d, k, x, n, round(x - lag(x, 1) OVER w, 3) AS diff_1, round((x - lag(x, 1) OVER w) / lag(x, 1) OVER w, 6) AS pct_1,
        round(x - lag(x, 5) OVER w, 3) AS diff_5, round((x - lag(x, 5) OVER w) / lag(x, 5) OVER w, 6) AS pct_5
    FROM day WINDOW w AS (PARTITION BY k ORDER BY d)
    """,
)
def macro_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = seasonal.changes(daily(spark, sf_dir), ["k"])
    return rounded(rounded(out, "pct_1", "pct_5"), "diff_1", "diff_5", digits=3)


@query(
    "rolling_z",
    f"""
    WITH {DAILY} SELECT d, k, x, n, round(CASE WHEN count(x) OVER w >= 3 AND stddev_samp(x) OVER w <> 0
        THEN (x - avg(x) OVER w) / stddev_samp(x) OVER w END, 5) AS z
    FROM day WINDOW w AS (PARTITION BY k ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
    """,
)
def rolling_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(seasonal.rolling_z(daily(spark, sf_dir), ["k"]), "z", digits=5)


@query(
    "rolling_volatility",
    f"""
    WITH {DAILY}, r AS (SELECT *, x / lag(x) OVER (PARTITION BY k ORDER BY d) - 1 AS r FROM day)
    SELECT d, k, x, n, round(CASE WHEN count(r) OVER w >= 21 THEN stddev_samp(r) OVER w END, 5) AS volatility
    FROM r WINDOW w AS (PARTITION BY k ORDER BY d ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)
    """,
)
def rolling_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(seasonal.rolling_volatility(daily(spark, sf_dir), ["k"]), "volatility", digits=5)


@query(
    "rolling_rank",
    f"""
    WITH {DAILY}, n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d) AS i FROM day)
    SELECT a.d, a.k, a.x, a.n, round(CASE WHEN count(*) >= 60 THEN count(*) FILTER (b.x <= a.x) * 100.0 / count(*) END, 6) AS pct_rank
    FROM n a JOIN n b ON a.k = b.k AND b.i BETWEEN a.i - 364 AND a.i GROUP BY a.d, a.k, a.x, a.n
    """,
)
def rolling_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(seasonal.rolling_rank(daily(spark, sf_dir), ["k"]), "pct_rank")


@query(
    "mid_rank_70",
    f"""
    WITH {DAILY}, n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d) AS i FROM day)
    SELECT a.d, a.k, a.x, a.n, round((count(*) FILTER (b.x < a.x - 1e-9) + 0.5 * count(*) FILTER (abs(b.x - a.x) <= 1e-9)) / count(*), 6) AS mid_rank
    FROM n a JOIN n b ON a.k = b.k AND b.i BETWEEN a.i - 69 AND a.i GROUP BY a.d, a.k, a.x, a.n
    """,
)
def mid_rank_70(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(seasonal.mid_rank(daily(spark, sf_dir), ["k"]), "mid_rank")


@query(
    "time_rolling",
    f"""
    WITH {HOURLY} SELECT ts, k, x, round(avg(x) OVER w, 6) AS roll_mean, round(stddev_samp(x) OVER w, 6) AS roll_std, CAST(sum(x) OVER w AS BIGINT) AS roll_sum
    FROM hr WINDOW w AS (PARTITION BY k ORDER BY ts RANGE BETWEEN INTERVAL '6 days 23:59:59.999999' PRECEDING AND CURRENT ROW)
    """,
)
def time_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(seasonal.time_rolling(hourly(spark, sf_dir), ["k"], "ts", "x", 7), "roll_mean", "roll_std")


@query(
    "forward_target",
    f"""
    WITH {DAILY}, c AS (
        SELECT *, lead(x) OVER (PARTITION BY k ORDER BY d) - x AS change,
               0.5 * stddev_samp(x) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS l FROM day
    ), f AS (SELECT *, first_value(l IGNORE NULLS) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS threshold FROM c)
    SELECT d, k, x, n, round(change, 2) AS change, round(threshold, 3) AS threshold,
           CASE WHEN change IS NOT NULL THEN CAST(change > threshold AS INT) END AS target FROM f
    """,
)
def forward_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = seasonal.forward_target(daily(spark, sf_dir), ["k"])
    return rounded(rounded(out, "change", digits=2), "threshold", digits=3)


@query(
    "day_delta",
    f"""
    WITH {DAILY} SELECT d, k, x, n, round(x - lag(x) OVER w, 2) AS delta, round((x - lag(x) OVER w) / lag(x) OVER w * 100, 5) AS delta_pct
    FROM day WINDOW w AS (PARTITION BY k ORDER BY d)
    """,
)
def day_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(seasonal.day_delta(daily(spark, sf_dir), ["k"]), "delta", digits=2), "delta_pct", digits=5)


@query(
    "ema_forecast",
    """
    WITH RECURSIVE day AS (SELECT CAST(ts AS DATE) AS d, event_type AS k, CAST(count(*) AS DOUBLE) AS x FROM events GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d) AS i FROM day),
    e AS (SELECT k, d, i, x AS m FROM n WHERE i = 1
          UNION ALL SELECT n.k, n.d, n.i, e.m + CAST(0.25 AS DOUBLE) * (n.x - e.m) FROM e JOIN n ON n.k = e.k AND n.i = e.i + 1),
    l AS (SELECT k, max(d) AS d, arg_max(m, i) AS m FROM e GROUP BY k)
    SELECT k, CAST(d + CAST(h AS INT) AS DATE) AS d, round(m, 6) AS forecast,
           round(greatest(least(m - 10 * (1 + 0.2 * h / 14), 200), 0), 6) AS low, round(greatest(least(m + 10 * (1 + 0.2 * h / 14), 200), 0), 6) AS high
    FROM l, range(1, 15) t(h)
    """,
)
def ema_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = moves(spark, sf_dir).groupBy(F.to_date("ts").alias("d"), F.col("event").alias("k")).agg(F.count(F.lit(1)).alias("x"))
    return rounded(seasonal.ema_forecast(rows, ["k"]), "forecast", "low", "high")


@query(
    "holt_forecast",
    f"""
    WITH RECURSIVE {HOURLY}, n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts) AS i FROM hr),
    f AS (
        SELECT k, CAST(1 AS BIGINT) AS i, CAST(x AS DOUBLE) AS lv, CAST(0 AS DOUBLE) AS tr, CAST(0 AS DOUBLE) AS s, CAST(0 AS DOUBLE) AS ss FROM n WHERE i = 1
        UNION ALL
        SELECT k, i, nl, 0.3::DOUBLE * (nl - lv) + 0.7::DOUBLE * tr, s + r, ss + r * r FROM (
            SELECT f.k, n.i, f.lv, f.tr, f.s, f.ss, n.x - (f.lv + f.tr) AS r, 0.3::DOUBLE * n.x + 0.7::DOUBLE * (f.lv + f.tr) AS nl
            FROM f JOIN n ON n.k = f.k AND n.i = f.i + 1)
    ), l AS (SELECT k, max(i) AS m, arg_max(lv, i) AS lv, arg_max(tr, i) AS tr, arg_max(s, i) AS s, arg_max(ss, i) AS ss FROM f GROUP BY k),
    g AS (SELECT *, coalesce(sqrt(greatest(ss / nullif(m - 1, 0) - (s / nullif(m - 1, 0)) ** 2, 0)), 0) AS sg FROM l)
    SELECT k, CAST(h AS INT) AS h, round(greatest(lv + h * tr, 0), 5) AS forecast, round(greatest(lv + h * tr - 1.96 * sg * sqrt(h), 0), 5) AS low,
           round(lv + h * tr + 1.96 * sg * sqrt(h), 5) AS high FROM g, range(1, 7) t(h)
    """,
)
def holt_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(seasonal.holt(hourly(spark, sf_dir), ["k"], d="ts"), "forecast", "low", "high", digits=5)


BAND_SQL = """CASE WHEN z IS NULL THEN NULL WHEN z < -2.5 THEN 'far below' WHEN z < -1.5 THEN 'well below' WHEN z < -0.5 THEN 'below'
    WHEN z < 0.5 THEN 'normal' WHEN z < 1.5 THEN 'above' WHEN z < 2.5 THEN 'well above' ELSE 'far above' END"""


@query(
    "relative_stress",
    f"""
    WITH {DAILY}, s AS (SELECT *, avg(x) OVER w AS mean, stddev_samp(x) OVER w AS std FROM day WINDOW w AS (PARTITION BY k, dayofyear(d))),
    z AS (SELECT *, CASE WHEN std <> 0 THEN (x - mean) / std END AS z FROM s)
    SELECT d, k, x, n, round(mean, 6) AS mean, round(std, 6) AS std, round(z, 6) AS z, round((x - mean) / mean * 100, 5) AS deviation_pct, {BAND_SQL} AS class FROM z
    """,
)
def relative_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = seasonal.relative_stress(daily(spark, sf_dir), ["k"])
    return rounded(rounded(out, "z", "mean", "std"), "deviation_pct", digits=5)


@query(
    "component_bands",
    f"""
    WITH {DAILY}, m AS (SELECT *, max(d) OVER (PARTITION BY k) AS top FROM day),
    b AS (SELECT k, dayofyear(d) AS doy, avg(x) AS mean, CASE WHEN stddev_samp(x) >= 1e-6 THEN stddev_samp(x) END AS std FROM m WHERE d > top - 400 GROUP BY ALL)
    SELECT day.d, day.k, x, CAST(dayofyear(day.d) AS INT) AS doy, round(mean, 3) AS mean, round(CASE WHEN std IS NOT NULL THEN greatest(mean - std, 0) END, 3) AS low_1,
           round(mean + std, 3) AS high_1, round(CASE WHEN std IS NOT NULL THEN greatest(mean - 2 * std, 0) END, 3) AS low_2, round(mean + 2 * std, 3) AS high_2,
           round((x - mean) / mean * 100, 4) AS deviation_pct
    FROM day LEFT JOIN b ON b.k = day.k AND b.doy = dayofyear(day.d)
    """,
)
def component_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = daily(spark, sf_dir).select("d", "k", "x")
    out = seasonal.component_bands(rows, seasonal.doy_baseline(rows, ["k"]).select("k", "doy", "mean", "std"), ["k"]).drop("std")
    return rounded(rounded(out, "mean", "low_1", "high_1", "low_2", "high_2", digits=3), "deviation_pct", digits=4)


@query(
    "fill_dates",
    """
    WITH day AS (SELECT CAST(o_orderdate AS DATE) AS d, c_custkey AS k, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    s AS (SELECT k, min(d) AS a, max(d) AS b FROM day GROUP BY k),
    g AS (SELECT k, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM s)
    SELECT g.k, g.d, day.n FROM g LEFT JOIN day USING (k, d)
    """,
)
def fill_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
    counts = rows.groupBy(F.to_date("o_orderdate").alias("d"), F.col("c_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return seasonal.fill_dates(counts, ["k"])


COMPONENTS = """
    src AS (
        SELECT CAST(o_orderdate AS DATE) AS d, r_name AS basin, count(*) AS c, round(sum(o_totalprice), 2) AS t
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL
    ), inp AS (
        SELECT d, basin, 'calls' AS comp, CAST(c AS DOUBLE) AS raw_value, 1 AS sign FROM src
        UNION ALL SELECT d, basin, 'value', t, -1 FROM src
    ), grid AS (
        SELECT * FROM (SELECT DISTINCT d FROM inp), (SELECT DISTINCT basin, comp, sign FROM inp)
    ), top AS (SELECT *, max(d) OVER (PARTITION BY basin, comp) AS top FROM inp),
    base AS (SELECT basin, comp, dayofyear(d) AS doy, avg(raw_value) AS mean, CASE WHEN stddev_samp(raw_value) >= 1e-6 THEN stddev_samp(raw_value) END AS std
             FROM top WHERE d > top - 400 GROUP BY ALL),
    comp AS (
        SELECT g.d, g.basin, g.comp, raw_value,
               CASE WHEN std <> 0 AND raw_value IS NOT NULL THEN least(greatest(g.sign * (raw_value - mean) / std, -5), 5) END AS z_value,
               CASE WHEN raw_value IS NULL THEN 'no_data' WHEN mean IS NULL OR std IS NULL THEN 'baseline_missing' WHEN std = 0 THEN 'flat_baseline' END AS missing_reason
        FROM grid g LEFT JOIN inp USING (d, basin, comp) LEFT JOIN base ON base.basin = g.basin AND base.comp = g.comp AND base.doy = dayofyear(g.d)
    )
"""


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    # nation and region are fixed dimensions of 25 and 5 rows
    places = F.broadcast(nations.join(F.broadcast(regions), nations["n_regionkey"] == regions["r_regionkey"]))
    rows = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    sums = rows.groupBy(F.to_date("o_orderdate").alias("d"), F.col("r_name").alias("basin")).agg(
        F.count(F.lit(1)).cast("double").alias("calls"), F.round(F.sum("o_totalprice"), 2).alias("value")
    )
    inputs = sums.unpivot(["d", "basin"], ["calls", "value"], "comp", "raw_value")
    signs = spark.createDataFrame([("calls", 1.0), ("value", -1.0)], "comp string, sign double")
    return indices.components_daily(inputs, signs)


@query("components_daily", f"WITH {COMPONENTS} SELECT d, basin, comp, raw_value, round(z_value, 5) + 0.0::DOUBLE AS z_value, missing_reason FROM comp")
def components_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(components(spark, sf_dir), "z_value", digits=5)


@query(
    "composite_component",
    f"""
    WITH {COMPONENTS}, p AS (
        SELECT d, basin, max(CASE WHEN comp = 'calls' THEN z_value END) AS a, max(CASE WHEN comp = 'value' THEN z_value END) AS b, sum(raw_value) AS raw_value
        FROM comp GROUP BY ALL
    )
    SELECT d, basin, 'trade' AS comp, round(raw_value, 2) AS raw_value, round((a + b) / 2, 5) + 0.0::DOUBLE AS z_value,
           CASE WHEN a IS NULL AND b IS NULL THEN 'both_missing' WHEN a IS NULL THEN 'calls_missing' WHEN b IS NULL THEN 'value_missing' END AS missing_reason FROM p
    """,
)
def composite_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = indices.composite(components(spark, sf_dir), ("calls", "value"), "trade")
    return rounded(rounded(out, "z_value", digits=5), "raw_value", digits=2)


@query(
    "basin_index",
    f"WITH {COMPONENTS} SELECT d, basin, round(100 * exp(avg(z_value)), 4) AS level, count(z_value) AS present FROM comp GROUP BY ALL",
)
def basin_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(indices.basin_index(components(spark, sf_dir)), "level", digits=4)


@query(
    "global_index",
    f"""
    WITH {COMPONENTS}, b AS (SELECT d, basin, 100 * exp(avg(z_value)) AS level FROM comp GROUP BY ALL)
    SELECT d, round(100 * exp(avg(ln(level / 100))), 4) AS level, count(level) AS basins FROM b GROUP BY d
    """,
)
def global_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(indices.global_index(indices.basin_index(components(spark, sf_dir))), "level", digits=4)


@query(
    "ops_coverage",
    f"""
    WITH {COMPONENTS}, r AS (SELECT * FROM comp WHERE d > (DATE '2000-06-30' - 30) AND d <= DATE '2000-06-30'),
    a AS (SELECT basin, d, max(CAST(z_value IS NOT NULL AS INT)) AS z FROM r GROUP BY ALL)
    SELECT basin, round(sum(z) / 30.0, 6) AS coverage, (SELECT count(DISTINCT comp) FROM r WHERE r.basin = a.basin AND z_value IS NOT NULL) AS present,
           (SELECT count(DISTINCT comp) FROM r WHERE r.basin = a.basin) AS expected FROM a GROUP BY basin
    """,
)
def ops_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(indices.coverage(components(spark, sf_dir), F.lit("2000-06-30").cast("date")), "coverage")


@query(
    "lite_index",
    f"""
    WITH {DAILY}, z AS (SELECT d, k, CASE WHEN stddev_samp(x) OVER w <> 0 THEN (x - avg(x) OVER w) / stddev_samp(x) OVER w ELSE 0 END AS z
                        FROM day WINDOW w AS (PARTITION BY k)),
    m AS (SELECT d, coalesce(max(CASE WHEN k = '1-URGENT' THEN z END), 0) AS a, coalesce(max(CASE WHEN k = '2-HIGH' THEN z END), 0) AS b,
                 coalesce(max(CASE WHEN k = '5-LOW' THEN z END), 0) AS c FROM z GROUP BY d),
    i AS (SELECT d, 100 * exp((0.5 * a + 0.3 * b + 0.2 * c) / 1.0) AS lv, 100 * exp((0.5 * a + 0.3 * b) / 0.8) AS wo FROM m)
    SELECT d, round_even(lv, 2) AS "index", round_even(wo, 2) AS index_without FROM i
    """,
)
def lite_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = daily(spark, sf_dir)
    whole = Window.partitionBy("k")
    z = F.coalesce(F.when(F.stddev_samp("x").over(whole) != 0, (F.col("x") - F.avg("x").over(whole)) / F.stddev_samp("x").over(whole)), F.lit(0.0))
    matrix = rows.withColumn("z", z).groupBy("d").agg(
        *[F.coalesce(F.max(F.when(F.col("k") == k, F.col("z"))), F.lit(0.0)).alias(n) for k, n in (("1-URGENT", "a"), ("2-HIGH", "b"), ("5-LOW", "c"))]
    )
    out = indices.lite_index(matrix, {"a": 0.5, "b": 0.3, "c": 0.2}, left_out="c")
    return out.select("d", "index", "index_without")


V15 = """
    f AS (SELECT CAST(o_orderdate AS DATE) AS ds, c_mktsegment AS gate_id, count(*) AS x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    h AS (SELECT a.ds, a.gate_id, a.x, list(b.x) AS xs, median(b.x) AS med FROM f a JOIN f b ON a.gate_id = b.gate_id AND b.ds BETWEEN a.ds - 30 AND a.ds GROUP BY ALL),
    m AS (SELECT *, list_median(list_transform(xs, lambda v: abs(v - med))) AS mad FROM h),
    s AS (SELECT *, CASE WHEN mad > 0 THEN 1 / (1 + exp(-least(greatest((x - med) / mad / 1.5, -10), 10))) ELSE 0.5 END AS score FROM m)
"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
    counts = rows.groupBy(F.to_date("o_orderdate").alias("ds"), F.col("c_mktsegment").alias("gate_id")).agg(F.count(F.lit(1)).alias("crossings"))
    return indices.flux_scores(counts)


@query("flux_scores", f"WITH {V15} SELECT ds, gate_id, x AS crossings, round(med, 6) AS med, round(mad, 6) AS mad, round(score, 6) AS score FROM s")
def flux_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scores(spark, sf_dir), "med", "mad", "score")


@query(
    "index_v15",
    f"""
    WITH {V15}, w(gate_id, weight) AS (VALUES ('AUTOMOBILE', 0.4::DOUBLE), ('BUILDING', 0.3::DOUBLE), ('MACHINERY', 0.2::DOUBLE)),
    j AS (SELECT ds, weight, CASE WHEN x % 3 = 0 THEN score ELSE 0.7 * score + 0.3 * least(x / 10.0, 1) END AS stress FROM s JOIN w USING (gate_id))
    SELECT ds, round(200 * sum(stress * weight) / sum(weight), 4) AS level, round(sum(weight), 6) AS weight_present, count(*) AS gates FROM j GROUP BY ds
    """,
)
def index_v15(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = spark.createDataFrame([("AUTOMOBILE", 0.4), ("BUILDING", 0.3), ("MACHINERY", 0.2)], "gate_id string, weight double")
    scores = _scores(spark, sf_dir).withColumn("sis", F.when(F.col("crossings") % 3 != 0, F.col("crossings") / 10.0))
    return rounded(rounded(indices.index_v15(scores, weights), "level", digits=4), "weight_present")


SAMPLES = """
    smp AS (SELECT CAST(l_shipdate AS DATE) AS ds, l_returnflag || '->' || l_linestatus AS corridor_id, l_quantity AS hc, l_discount AS hw, l_tax AS we FROM lineitem)
"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("ds"), F.concat("l_returnflag", F.lit("->"), "l_linestatus").alias("corridor_id"),
        F.col("l_quantity").cast("double").alias("hc"), F.col("l_discount").cast("double").alias("hw"), F.col("l_tax").cast("double").alias("we"), "l_orderkey",
    )


@query(
    "sis_daily",
    f"""
    WITH {SAMPLES}, t AS (SELECT corridor_id, ds AS day FROM (SELECT corridor_id, ds, row_number() OVER (PARTITION BY corridor_id ORDER BY ds DESC) AS n
                          FROM (SELECT DISTINCT corridor_id, ds FROM smp)) WHERE n <= 7),
    b AS (SELECT t.corridor_id, day, quantile_cont(hc, [0.05, 0.95]) AS a, quantile_cont(hw, [0.05, 0.95]) AS b, quantile_cont(we, [0.05, 0.95]) AS c
          FROM t JOIN smp ON smp.corridor_id = t.corridor_id AND ds <= day AND ds > day - 730 GROUP BY ALL),
    s AS (SELECT smp.ds, smp.corridor_id, smp.hc, smp.hw, smp.we, 1 / (1 + exp(-(
              0.5 * coalesce(CASE WHEN a[2] > a[1] THEN least(greatest((hc - a[1]) / (a[2] - a[1]), 0), 1) END, 0)
            + 0.35 * coalesce(CASE WHEN b[2] > b[1] THEN least(greatest((hw - b[1]) / (b[2] - b[1]), 0), 1) END, 0)
            + 0.15 * coalesce(CASE WHEN c[2] > c[1] THEN least(greatest((we - c[1]) / (c[2] - c[1]), 0), 1) END, 0)))) AS sis
          FROM smp JOIN b ON b.corridor_id = smp.corridor_id AND b.day = smp.ds)
    SELECT ds, corridor_id, round(avg(sis), 6) AS sis_mean, round(quantile_cont(sis, 0.9), 6) AS sis_p90,
           round(quantile_cont(hc, 0.9), 6) AS hc_p90, round(quantile_cont(hw, 0.9), 6) AS hw_p90, round(quantile_cont(we, 0.9), 6) AS we_p90, round(avg(CAST(sis >= 0.7 AS INT)), 6) AS pct_sis_high, count(*) AS n_samples FROM s GROUP BY ALL
    """,
)
def sis_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sea_state.impact_daily(samples(spark, sf_dir)), "sis_mean", "sis_p90", "hc_p90", "hw_p90", "we_p90", "pct_sis_high")


@query(
    "region_sea_stats",
    f"""
    WITH l AS (SELECT l_returnflag AS region, CASE WHEN l_quantity > 45 THEN 'NaN'::DOUBLE ELSE l_quantity END AS hs, l_orderkey FROM lineitem)
    SELECT region, round(avg(hs) FILTER (NOT isnan(hs)), 6) AS mean, round(quantile_cont(hs, 0.9) FILTER (NOT isnan(hs)), 6) AS p90,
           count(DISTINCT l_orderkey) AS vessels, count(*) AS n FROM l GROUP BY region
    """,
)
def region_sea_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("region"), F.when(F.col("l_quantity") > 45, float("nan")).otherwise(F.col("l_quantity").cast("double")).alias("hs"), "l_orderkey"
    )
    return rounded(sea_state.region_stats(rows, ["region"], "hs", "l_orderkey"), "mean", "p90")


@query(
    "circular_mean",
    """
    SELECT event_type AS k, CAST(date_trunc('day', ts) AS DATE) AS d,
           round(((degrees(atan2(avg(sin(radians(value * 3.6))), avg(cos(radians(value * 3.6))))) % 360) + 360) % 360, 4) AS mean_cog, round(avg(value), 6) AS mean_sog
    FROM events GROUP BY ALL
    """,
)
def circular_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = moves(spark, sf_dir)
    out = rows.groupBy(F.col("event").alias("k"), F.to_date("ts").alias("d")).agg(
        sea_state.circular_mean(F.col("sog") * 3.6).alias("mean_cog"), F.avg("sog").alias("mean_sog")
    )
    return rounded(rounded(out, "mean_cog", digits=4), "mean_sog")


@query(
    "opposing_component",
    """
    SELECT l_orderkey, l_linenumber,
           round(-(l_discount * cos(radians(l_quantity * 7)) + l_tax * sin(radians(l_quantity * 7))) * 1.94384, 6) + 0.0::DOUBLE AS head_current_kn,
           round(-(l_tax * cos(radians(l_quantity * 7)) + l_discount * sin(radians(l_quantity * 7))), 6) + 0.0::DOUBLE AS head_wind_ms, l_quantity AS wave_encounter_m
    FROM lineitem
    """,
)
def opposing_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") * 7).alias("mean_cog"), F.col("l_discount").alias("uo"), F.col("l_tax").alias("vo"),
        F.col("l_tax").alias("u10"), F.col("l_discount").alias("v10"), F.col("l_quantity").alias("hs"),
    )
    out = sea_state.head_components(rows).select("l_orderkey", "l_linenumber", "head_current_kn", "head_wind_ms", "wave_encounter_m")
    return rounded(out, "head_current_kn", "head_wind_ms")


@query(
    "flux_metrics",
    """
    WITH g AS (SELECT event_type AS gate_id, count(*) AS flux, avg(value) AS v, stddev_samp(value) AS s FROM events GROUP BY ALL),
    m AS (SELECT median(flux) AS m, max(flux) AS top FROM g), a AS (SELECT median(abs(flux - m)) AS mad FROM g, m)
    SELECT gate_id, flux, round(least(greatest((flux - m) / CASE WHEN mad < 1e-6 THEN greatest(1, m) ELSE mad END, -3), 3), 6) AS z_clipped,
           round(1 + least(0.5, 0.3 * flux / top), 6) AS delay, round(0.5 * least(v / 10 / 5, 1) + 0.35 * least(abs(-s) / 10 / 3.5, 1) + 0.15 * least(v / 4 / 15, 1), 3) AS sis_proxy FROM g, m, a
    """,
)
def flux_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = moves(spark, sf_dir).groupBy("gate_id").agg(F.count(F.lit(1)).alias("flux"), F.avg("sog").alias("v"), F.stddev_samp("sog").alias("s"))
    out = sea_state.flux_metrics(rows, F.col("v") / 10, -F.col("s") / 10, F.col("v") / 4).drop("v", "s")
    return rounded(out, "z_clipped", "delay", "sis_proxy")


BUNDLE = """
    md AS (SELECT *, median(x) OVER (PARTITION BY k) AS m FROM hr),
    b AS (SELECT k, avg(x) AS mean, stddev_samp(x) AS std, median(x) AS median, median(abs(x - m)) AS mad, quantile_cont(x, 0.95) AS p95, quantile_cont(x, 0.05) AS p05 FROM md GROUP BY k)
"""


@query(
    "baseline_bundle",
    f"WITH {HOURLY}, {BUNDLE} SELECT k, round(mean, 6) AS mean, round(std, 6) AS std, median, mad, round(p95, 6) AS p95, round(p05, 6) AS p05 FROM b",
)
def baseline_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(detect.baseline_bundle(hourly(spark, sf_dir), ["k"], "x"), "mean", "std", "p95", "p05")


@query(
    "hourly_anomaly_point",
    f"""
    WITH {HOURLY}, {BUNDLE}, z AS (SELECT hr.*, CASE WHEN mad > 0 THEN 0.6745 * (x - median) / mad WHEN std <> 0 THEN (x - mean) / std END AS z FROM hr JOIN b USING (k))
    SELECT k, ts, x, round(z, 6) AS z, round(least(1, (abs(z) - 2.5) / 5), 6) AS severity, CASE WHEN z > 0 THEN 'high' ELSE 'low' END AS kind FROM z WHERE abs(z) > 2.5
    """,
)
def hourly_anomaly_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.point_anomalies(hourly(spark, sf_dir), ["k"], "x", limit=2.5)
    return rounded(found.select("k", "ts", "x", "z", "severity", "kind"), "z", "severity")


@query(
    "hourly_anomaly_series",
    f"""
    WITH {HOURLY}, z AS (SELECT *, CASE WHEN count(x) OVER w >= 6 AND stddev_samp(x) OVER w <> 0 THEN (x - avg(x) OVER w) / stddev_samp(x) OVER w END AS z
                         FROM hr WINDOW w AS (PARTITION BY k ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
    SELECT k, ts, x, round(z, 6) AS z, round(least(1, (abs(z) - 2.5) / 3), 6) AS severity FROM z WHERE abs(z) > 2.5
    """,
)
def hourly_anomaly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(detect.series_anomalies(hourly(spark, sf_dir), ["k"], "ts", "x", limit=2.5), "z", "severity")


@query(
    "long_stay_counts",
    """
    WITH v AS (SELECT o_orderpriority AS polygon_id, (epoch(l_shipdate) - epoch(o_orderdate)) / 3600.0 AS h FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT polygon_id, CAST(sum(CASE WHEN h >= 1440 THEN 1 ELSE 0 END) AS BIGINT) AS count_vlcc, CAST(sum(CASE WHEN h >= 720 THEN 1 ELSE 0 END) AS BIGINT) AS count_other
    FROM v GROUP BY ALL
    """,
)
def long_stay_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.functions.columns import epoch_seconds

    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    visits = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).withColumnRenamed("o_orderpriority", "polygon_id")
    hours = (epoch_seconds("l_shipdate") - epoch_seconds("o_orderdate")) / 3600.0
    return detect.long_stays(visits, hours, long=1440.0, other=720.0)


@query(
    "robust_spread",
    """
    WITH n AS (SELECT o_orderpriority AS k, o_orderstatus AS s, count(*) AS x FROM orders GROUP BY ALL),
    m AS (SELECT *, median(x) OVER (PARTITION BY k) AS median FROM n),
    a AS (SELECT *, median(abs(x - median)) OVER (PARTITION BY k) AS mad FROM m)
    SELECT k, s, x, median, CASE WHEN mad < 1e-6 THEN greatest(1, median) ELSE mad END AS spread FROM a
    """,
)
def robust_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("k"), F.col("o_orderstatus").alias("s")).agg(F.count(F.lit(1)).alias("x"))
    return detect.robust_spread(rows, ["k"], "x")


@query(
    "stagnant_series",
    f"""
    WITH {DAILY}, s AS (SELECT k, CASE WHEN count(n) OVER w >= 30 THEN stddev_samp(n) OVER w END AS s FROM day WINDOW w AS (PARTITION BY k ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
    SELECT k, count(*) AS n, round(max(s), 6) AS most_std, count(*) >= 120 AND coalesce(max(s), 0) = 0 AS stagnant FROM s GROUP BY k
    """,
)
def stagnant_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = daily(spark, sf_dir).select("d", "k", F.col("n").alias("x"))
    return rounded(detect.stagnant(rows, ["k"], "d", "x"), "most_std")
