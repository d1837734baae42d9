"""Queries on daily sums, joins of parts, series views, snapshots and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.storage import cut
from tideline.functions.tables import table
from tideline.operators import contracts, daily, detect, dwell, flux, geo, models, sea_state, snapshots
from tideline.plans.flow_queries import GATED, K, crossings, fixes, k, rounded
from tideline.plans.place_queries import POINTS, points
from tideline.plans.registry import query
from tideline.plans.series_queries import DAILY
from tideline.plans.series_queries import daily as day_series
from tideline.sources import ais, ports, static

NOW = "TIMESTAMP '2024-01-25 00:00:00'"
WINDOWS = """
    win AS (SELECT time_bucket(INTERVAL '10 minutes', msg_time) AS window_start, region, count(DISTINCT CASE WHEN sog < 50 THEN mmsi END) AS slow_count
            FROM (SELECT user_id AS mmsi, ts AS msg_time, event_type AS region, value AS sog FROM events) GROUP BY ALL)
"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dwell.dwell_windows(fixes(spark, sf_dir), F.col("sog") < 50)


@query(
    "registry_enrich",
    f"""
    SELECT e.event_id, e.user_id AS mmsi, coalesce(CASE WHEN {K} % 3 = 0 THEN {K} % 30 + 70 END, c_custkey % 30 + 65) AS shiptype_num,
           coalesce(coalesce(CASE WHEN {K} % 3 = 0 THEN {K} % 30 + 70 END, c_custkey % 30 + 65) BETWEEN 80 AND 89, false) AS is_tanker
    FROM events e LEFT JOIN customer ON c_custkey = e.user_id
    """,
)
def registry_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("mmsi"), F.when(k() % 3 == 0, k() % 30 + 70).cast("int").alias("shiptype_num"), F.lit(None).cast("string").alias("shiptype_str")
    )
    static = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("mmsi"), (F.col("c_custkey") % 30 + 65).cast("string").alias("ship_type"))
    return ais.enrich(rows, static).select("event_id", "mmsi", "shiptype_num", "is_tanker")


@query(
    "port_calls",
    """
    SELECT CAST(o_orderdate AS TIMESTAMP) AS ts, lower(trim(o_orderpriority)) AS event, CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 7 ELSE 1 END AS INT) AS vessels,
           o_orderstatus = 'F' AS is_tanker, count(*) AS n FROM orders GROUP BY ALL
    """,
)
def port_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    raw = table(spark, sf_dir, "orders").select(
        F.lit(None).cast("string").alias("timestamp"), F.col("o_orderdate").cast("string").alias("time"), F.concat(F.lit("  "), F.upper("o_orderpriority"), F.lit(" ")).alias("movement"),
        F.when(key % 2 == 0, (key % 7).cast("string")).alias("count"), F.col("o_orderstatus").alias("cargo"),
    )
    calls = ports.normalize_calls(raw, ("timestamp", "time"), ("event", "movement"), ("vessels", "count"), F.col("cargo") == "F")
    return calls.groupBy(F.col("ts").cast("timestamp_ntz").alias("ts"), "event", "vessels", "is_tanker").agg(F.count(F.lit(1)).alias("n"))


@query(
    "box_current_speed",
    """
    SELECT l_returnflag AS region, round(sqrt(avg(l_discount) ** 2 + avg(l_tax) ** 2) * 1.94384, 6) AS speed_kn, sqrt(avg(l_discount) ** 2 + avg(l_tax) ** 2) * 1.94384 >= 0.1 AS flag
    FROM lineitem GROUP BY 1
    """,
)
def box_current_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("region"), F.col("l_discount").alias("u"), F.col("l_tax").alias("v"))
    return rounded(sea_state.speed_of_means(grid, ["region"], "u", "v", 0.1), "speed_kn")


@query(
    "ingest_health",
    f"""
    SELECT count(*) AS messages, count(DISTINCT user_id) AS vessels, round(avg(CASE WHEN {K} % 4 = 0 THEN 1 ELSE 0 END), 6) AS tanker_share
    FROM events WHERE ts BETWEEN {NOW} - INTERVAL 240 MINUTES AND {NOW}
    """,
)
def ingest_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("mmsi"), F.col("ts").alias("rx_time"), (k() % 4 == 0).alias("is_tanker"))
    return rounded(ais.ingest_health(rows, F.expr("TIMESTAMP_NTZ '2024-01-25 00:00:00'"), minutes=240), "tanker_share")


@query("dwell_sums_daily", f"WITH {WINDOWS} SELECT CAST(window_start AS DATE) AS d, region, CAST(sum(slow_count) AS BIGINT) AS slow_sum, count(*) AS windows FROM win GROUP BY ALL")
def dwell_sums_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.dwell_daily(windows(spark, sf_dir))


@query(
    "sea_means_daily",
    """
    SELECT CAST(l_shipdate AS DATE) AS d, l_returnflag AS region, round(avg(l_discount), 6) AS hs_mean, round(avg(l_tax), 6) AS uo_mean, max(l_shipdate) AS latest FROM lineitem GROUP BY 1, 2
    """,
)
def sea_means_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_shipdate", F.col("l_returnflag").alias("region"), F.col("l_discount").alias("hs"), F.col("l_tax").alias("uo"))
    return rounded(daily.daily_means(rows, "l_shipdate", ["region"], "hs", "uo"), "hs_mean", "uo_mean")


@query(
    "source_sums_daily",
    """
    SELECT CAST(o_orderdate AS DATE) AS d, CAST(sum(CASE WHEN lower(o_orderpriority) = '1-urgent' THEN o_orderkey % 7 ELSE 0 END) AS BIGINT) AS "1_urgent",
           CAST(sum(CASE WHEN lower(o_orderpriority) = '5-low' THEN o_orderkey % 7 ELSE 0 END) AS BIGINT) AS "5_low" FROM orders GROUP BY 1
    """,
)
def source_sums_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderpriority", (F.col("o_orderkey") % 7).alias("x"))
    return daily.conditional_sums(rows, "o_orderdate", "o_orderpriority", "x", ["1-urgent", "5-low"])


@query("chokepoint_mean", f"WITH {DAILY} SELECT d, round(avg(x), 4) AS x, count(x) AS sources FROM day WHERE k IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY d")
def chokepoint_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = day_series(spark, sf_dir)
    return rounded(daily.mean_of_sources([rows.where(F.col("k") == name).select("d", "x") for name in ("1-URGENT", "2-HIGH", "3-MEDIUM")], "d", "x"), "x", digits=4)


@query(
    "corridor_weather_daily",
    """
    SELECT CAST(l_shipdate AS DATE) AS d, l_linestatus AS corridor_id, round(avg(sqrt(l_discount ** 2 + l_tax ** 2) * 1.94384), 6) AS speed_kn, count(*) AS n FROM lineitem GROUP BY 1, 2
    """,
)
def corridor_weather_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_shipdate", F.col("l_linestatus").alias("corridor_id"), F.col("l_discount").alias("u"), F.col("l_tax").alias("v"))
    return rounded(daily.corridor_weather(rows, "l_shipdate", "corridor_id", "u", "v"), "speed_kn")


@query("event_flux_daily", "SELECT CAST(ts AS DATE) AS ds, event_type AS gate_id, count(*) AS crossings, 'UNK' AS direction FROM events GROUP BY 1, 2")
def event_flux_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.event_flux(table(spark, sf_dir, "events").withColumnRenamed("event_type", "gate_id"))


@query(
    "crossing_fixes",
    f"""
    WITH {GATED}, f AS (SELECT CASE WHEN value > 30 THEN user_id ELSE -1 - user_id END AS mmsi, ts, max(value) AS sog FROM events GROUP BY ALL)
    SELECT g.mmsi, g.ts, gate_id, direction, sog FROM g LEFT JOIN f USING (mmsi, ts)
    """,
)
def crossing_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slow fixes count as those of vessels that cross nothing, so that some crossings have no fix."""
    vessel = F.when(F.col("value") > 30, F.col("user_id")).otherwise(-1 - F.col("user_id"))
    seen = table(spark, sf_dir, "events").groupBy(vessel.alias("mmsi"), "ts").agg(F.max("value").alias("sog"))
    return daily.crossings_with_fixes(crossings(spark, sf_dir).drop("value"), seen).select("mmsi", "ts", "gate_id", "direction", "sog")


@query(
    "tracklet_samples",
    """
    SELECT o_orderpriority AS corridor_id, CAST(o_orderdate AS DATE) AS ds, round(avg(l_discount), 6) AS mean, round(quantile_cont(l_discount, 0.9), 6) AS p90, count(*) AS n
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2
    """,
)
def tracklet_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tracklet_id"), F.col("l_discount").alias("score"))
    tracks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tracklet_id"), F.col("o_orderpriority").alias("corridor_id"), F.to_date("o_orderdate").alias("ds"))
    return rounded(daily.samples_of_tracklets(samples, tracks, ["corridor_id", "ds"]), "mean", "p90")


@query(
    "polygon_buffer_join",
    f"""
    WITH {POINTS}, q AS (SELECT point_id, greatest(abs(lat - 10.05) - 20, 0) AS a, greatest(abs(lon - 5.05) - 30, 0) AS b FROM p)
    SELECT point_id, 'BOX' AS polygon_id FROM q WHERE sqrt(a * a + b * b) <= 7.3
    """,
)
def polygon_buffer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = spark.createDataFrame([("BOX", [-24.95, 35.05, 35.05, -24.95], [-9.95, -9.95, 30.05, 30.05])], "polygon_id string, xs array<double>, ys array<double>")
    return geo.polygon_join(points(spark, sf_dir), box, buffer=7.3).select("point_id", "polygon_id")


@query(
    "features_market",
    f"WITH {DAILY}, m AS (SELECT CAST(l_shipdate AS DATE) AS d, round(sum(l_tax), 4) AS price FROM lineitem GROUP BY 1) SELECT d, k, x, price FROM day JOIN m USING (d)",
)
def features_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    market = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("d")).agg((F.round(F.sum("l_tax"), 4)).alias("price"))
    return daily.features_with_market(day_series(spark, sf_dir), market).select("d", "k", "x", "price")


@query(
    "route_alert",
    """
    WITH f AS (SELECT CAST(ts AS DATE) AS ds, event_type AS g, count(*) AS n FROM events GROUP BY 1, 2),
    s AS (SELECT sum(CASE WHEN ds > DATE '2024-01-22' AND g = 'view' THEN n ELSE 0 END) AS a, sum(CASE WHEN ds > DATE '2024-01-22' AND g = 'purchase' THEN n ELSE 0 END) AS b,
                 sum(CASE WHEN ds <= DATE '2024-01-22' AND ds > DATE '2024-01-07' AND g = 'view' THEN n ELSE 0 END) AS c,
                 sum(CASE WHEN ds <= DATE '2024-01-22' AND ds > DATE '2024-01-07' AND g = 'purchase' THEN n ELSE 0 END) AS d FROM f WHERE ds <= DATE '2024-01-25')
    SELECT CAST(a AS BIGINT) AS recent_crossings, round(a / nullif(a + b, 0), 6) AS recent_share, round(c / nullif(c + d, 0), 6) AS baseline_share
    FROM s WHERE a / nullif(a + b, 0) - c / nullif(c + d, 0) >= -0.5 AND a >= 10
    """,
)
def route_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alert of a shifted route, with a jump that the shared events reach."""
    flow = daily.event_flux(table(spark, sf_dir, "events").withColumnRenamed("event_type", "gate_id")).where("ds <= DATE '2024-01-25'")
    shares = flux.route_share(flow, "view", "purchase", F.lit("2024-01-25").cast("date"))
    return rounded(detect.route_deviation(shares, jump=-0.5), "recent_share", "baseline_share")


@query(
    "psi_drift",
    """
    WITH v AS (SELECT l_discount + CASE WHEN l_returnflag = 'R' THEN l_tax / 4 ELSE 0 END AS x, l_returnflag = 'R' AS late FROM lineitem),
    e AS (SELECT i, i / 80 AS lo, (i + 1) / 80 AS hi FROM range(8) r(i)),
    c AS (SELECT i, count(*) FILTER (NOT late) AS b, count(*) FILTER (late) AS n FROM v JOIN e ON x >= lo AND (x < hi OR (i = 7 AND x = hi)) GROUP BY i),
    s AS (SELECT b / sum(b) OVER () AS p, n / sum(n) OVER () AS q FROM c)
    SELECT round(sum((q - p) * ln(greatest(q / greatest(p, 1e-6), 1e-6))), 6) AS psi FROM s
    """,
)
def psi_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over eight bins of 0 to 0.1, beyond which some of the later values lie."""
    lines = table(spark, sf_dir, "lineitem")
    base, now = lines.where("l_returnflag <> 'R'").select(F.col("l_discount").alias("x")), lines.where("l_returnflag = 'R'").select((F.col("l_discount") + F.col("l_tax") / 4).alias("x"))
    return rounded(models.psi(base, now, "x", [i / 80 for i in range(9)]), "psi")


@query(
    "ks_drift",
    """
    WITH v AS (SELECT l_quantity AS x, sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS b, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n FROM lineitem GROUP BY 1)
    SELECT round(max(abs(cb - cn)), 6) AS ks FROM (SELECT sum(b) OVER (ORDER BY x) / (SELECT sum(b) FROM v) AS cb, sum(n) OVER (ORDER BY x) / (SELECT sum(n) FROM v) AS cn FROM v)
    """,
)
def ks_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), "l_returnflag")
    return rounded(models.ks(lines.where("l_returnflag <> 'R'").select("x"), lines.where("l_returnflag = 'R'").select("x"), "x"), "ks")


@query(
    "base_rate_drift",
    """
    WITH s AS (SELECT avg(CASE WHEN o_orderdate < DATE '2001-07-02' THEN CAST(o_orderstatus = 'F' AS INT) END) AS base_rate, avg(CASE WHEN o_orderdate >= DATE '2001-07-02' THEN CAST(o_orderstatus = 'F' AS INT) END) AS recent_rate
               FROM (SELECT CAST(o_orderdate AS DATE) AS o_orderdate, o_orderstatus FROM orders))
    SELECT round(base_rate, 6) AS base_rate, round(recent_rate, 6) AS recent_rate, round(abs(recent_rate - base_rate), 6) AS shift FROM s
    """,
)
def base_rate_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"), (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    return rounded(daily.base_rate_shift(rows, "d", "label", F.lit("2001-12-31").cast("date"), days=183), "base_rate", "recent_rate", "shift")


@query(
    "momentum_fallback",
    f"""
    WITH {DAILY}, r AS (
        SELECT *, x / lag(x) OVER v - 1 AS ret, coalesce((x - lag(x, 6) OVER v) / lag(x, 6) OVER v, 0) AS r7, coalesce((x - lag(x, 20) OVER v) / lag(x, 20) OVER v, 0) AS r21
        FROM day WINDOW v AS (PARTITION BY k ORDER BY d)
    ), w AS (SELECT *, CASE WHEN count(ret) OVER f >= 21 THEN stddev_samp(ret) OVER f END AS vol FROM r WINDOW f AS (PARTITION BY k ORDER BY d ROWS 20 PRECEDING)),
    e AS (
        SELECT k, arg_max(r7, d) AS r7, arg_max(r21, d) AS r21, count(*) AS n,
               greatest(least(arg_max(vol, d) FILTER (vol IS NOT NULL), quantile_cont(vol, 0.99)), quantile_cont(vol, 0.01)) AS vol FROM w GROUP BY k
    )
    SELECT k, round(r7, 6) AS r7, round(r21, 6) AS r21, round(vol, 6) AS vol21, CASE WHEN n < 22 THEN 'insufficient_history' WHEN vol > 0.25 THEN 'high_volatility' END AS reason,
           round(CASE WHEN n < 22 OR vol > 0.25 THEN 0.5 ELSE least(greatest(0.5 + 0.5 * tanh((r7 - 0.5 * r21) / CASE WHEN vol > 0 THEN vol ELSE 1e-6 END * 3), 0.35), 0.65) END, 5) AS p FROM e
    """,
)
def momentum_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = daily.momentum_probability(day_series(spark, sf_dir), ["k"], "d", "x", most_volatile=0.25)
    return rounded(rounded(out, "p", digits=5), "r7", "r21", "vol21")


@query(
    "paired_series",
    f"""
    WITH {DAILY}, t AS (SELECT * FROM day WHERE d >= (SELECT max(d) FROM day) - 29)
    SELECT d, k, n, CAST(sum(n) OVER (PARTITION BY k) AS BIGINT) AS n_total FROM t
    """,
)
def paired_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.series_with_totals(day_series(spark, sf_dir).drop("x"), ["k"], "d", 30, "n")


@query(
    "dedup_flux_totals",
    f"""
    WITH {GATED}, day AS (SELECT CAST(ts AS DATE) AS ds, gate_id, count(*) AS crossings, count(DISTINCT mmsi) AS vessels FROM g GROUP BY 1, 2),
    t AS (SELECT * FROM day WHERE ds >= (SELECT max(ds) FROM day) - 6)
    SELECT ds, gate_id, crossings, vessels, CAST(sum(crossings) OVER w AS BIGINT) AS crossings_total, CAST(sum(vessels) OVER w AS BIGINT) AS vessels_total FROM t WINDOW w AS (PARTITION BY gate_id)
    """,
)
def dedup_flux_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_day = crossings(spark, sf_dir).groupBy(F.to_date("ts").alias("ds"), "gate_id").agg(F.count(F.lit(1)).alias("crossings"), F.countDistinct("mmsi").alias("vessels"))
    return snapshots.series_with_totals(by_day, ["gate_id"], "ds", 7, "crossings", "vessels")


@query(
    "transit_series",
    f"WITH {DAILY} SELECT d, k, x, CAST(row_number() OVER (PARTITION BY k ORDER BY d DESC) AS INT) AS place FROM day WHERE k IN ('1-URGENT', '2-HIGH') AND k LIKE '_-%'",
)
def transit_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = snapshots.filtered(day_series(spark, sf_dir), k="_-%", x=None)
    return snapshots.series_view(rows, "d", ["k"], k=["1-URGENT", "2-HIGH"]).select("d", "k", "x", "place")


@query(
    "oil_latest",
    f"WITH {DAILY} SELECT k AS series, count(*) AS points, max(d) AS ds, arg_max(x, d) AS value FROM day WHERE k IN ('1-URGENT', '5-LOW') GROUP BY 1",
)
def oil_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = day_series(spark, sf_dir).select(F.col("k").alias("series"), F.col("d").alias("ds"), F.col("x").alias("value"))
    return snapshots.latest_of_series(rows, "series", "ds", "value", ["1-URGENT", "5-LOW"])


@query(
    "registry_lookup",
    """
    WITH v AS (SELECT user_id AS mmsi, count(*) AS fixes FROM events GROUP BY 1)
    SELECT v.mmsi, fixes, c_mktsegment AS segment, c_custkey IS NOT NULL AS known FROM v LEFT JOIN customer ON c_custkey = v.mmsi * 2
    """,
)
def registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vessels = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("mmsi")).agg(F.count(F.lit(1)).alias("fixes"))
    held = table(spark, sf_dir, "customer").select((F.col("c_custkey") / 2).alias("mmsi"), F.col("c_mktsegment").alias("segment"))
    return snapshots.with_registry(vessels, held)


@query(
    "nulls_last_top",
    f"""
    WITH v AS (SELECT user_id AS mmsi, max(CASE WHEN {K} % 5 <> 0 THEN value END) AS x FROM events GROUP BY 1)
    SELECT mmsi, x, CAST(row_number() OVER (ORDER BY x DESC NULLS LAST, mmsi) AS INT) AS place FROM v ORDER BY x DESC NULLS LAST, mmsi LIMIT 300
    """,
)
def nulls_last_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("mmsi")).agg(F.max(F.when(k() % 5 != 0, F.col("value"))).alias("x"))
    return snapshots.top_nulls_last(rows, "x", ["mmsi"], 300)


@query(
    "clean_signals",
    """
    SELECT p_partkey AS id, '{"a":' || (p_partkey % 7) || '.0,"b":' || CASE WHEN p_partkey % 3 = 0 THEN 'null' ELSE (p_partkey % 5) || '.5' END || '}' AS body FROM part
    """,
)
def clean_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    nan = F.when(key % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    rows = table(spark, sf_dir, "part").select(key.alias("id"), (key % 7).cast("double").alias("a"), F.when(key % 3 == 0, nan).otherwise(key % 5 + 0.5).alias("b"))
    return rows.select("id", snapshots.clean_json("a", "b").alias("body"))


SNAPSHOT = f"""
    {DAILY}, l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d DESC) AS place FROM day), t AS (SELECT * FROM l WHERE place <= 70),
    h AS (SELECT k, max(d) AS newest, max(CASE WHEN place = 1 THEN x END) AS value, max(CASE WHEN place = 2 THEN x END) AS before FROM t GROUP BY k),
    r AS (SELECT k, newest, value, before, sum(CASE WHEN abs(x - value) <= 1e-8 + 1e-5 * abs(value) THEN 0.5::DOUBLE WHEN x < value THEN 1 ELSE 0 END) / count(*) * 100 AS rank_pct FROM t JOIN h USING (k) GROUP BY ALL)
"""


@query(
    "index_snapshot",
    f"WITH {SNAPSHOT} SELECT k, newest, value, round(value - before, 4) AS delta, round((value - before) / before * 100, 4) AS delta_pct, round(rank_pct, 4) AS rank_pct FROM r",
)
def index_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(snapshots.index_snapshot(day_series(spark, sf_dir), ["k"]), "delta", "delta_pct", "rank_pct", digits=4)


@query("signals_snapshot", f"WITH {SNAPSHOT} SELECT k, newest, round(rank_pct, 4) AS rank_pct, rank_pct >= 90 AS top_decile FROM r")
def signals_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(snapshots.signals_snapshot(day_series(spark, sf_dir), ["k"]).select("k", "newest", "rank_pct", "top_decile"), "rank_pct", digits=4)


@query(
    "corridor_features",
    """
    WITH s AS (SELECT event_type AS gate_id, count(*) AS flux, round(avg(value), 6) AS z FROM events GROUP BY 1),
    c AS (SELECT * FROM (VALUES ('A', 'Alpha', 'view'), ('A', 'Alpha', 'purchase'), ('B', 'Beta', 'click'), ('B', 'Beta', 'none'), ('C', 'Gamma', 'nowhere')) t(corridor_id, name, gate_id))
    SELECT corridor_id, name, CAST(sum(coalesce(flux, 0)) AS BIGINT) AS flux, coalesce(max(z), 0) AS z FROM c LEFT JOIN s USING (gate_id) GROUP BY 1, 2 HAVING sum(coalesce(flux, 0)) > 0
    """,
)
def corridor_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("gate_id")).agg(F.count(F.lit(1)).alias("flux"), F.round(F.avg("value"), 6).alias("z"))
    catalogue = spark.createDataFrame([("A", "Alpha", ["view", "purchase"]), ("B", "Beta", ["click", "none"]), ("C", "Gamma", ["nowhere"])], "corridor_id string, name string, gates array<string>")
    return snapshots.corridor_features(summary, catalogue)


@query("tracklet_extent", f"WITH {POINTS} SELECT mmsi, min(lat) - 2 AS south, max(lat) + 2 AS north, min(lon) - 2 AS west, max(lon) + 2 AS east FROM p GROUP BY 1")
def tracklet_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.extent(points(spark, sf_dir), ["mmsi"])


@query(
    "dwell_proxy_component",
    """
    WITH f AS (SELECT ts + to_years(CAST(user_id % 3 AS INT)) AS t, user_id, event_type AS region, value FROM events),
    win AS (SELECT time_bucket(INTERVAL '10 minutes', t) AS window_start, region, count(DISTINCT CASE WHEN value < 50 THEN user_id END) AS slow_count FROM f GROUP BY ALL),
    r AS (SELECT CAST(window_start AS DATE) AS d, CAST(sum(slow_count) AS DOUBLE) AS x FROM win WHERE region = 'view' GROUP BY 1),
    b AS (SELECT *, avg(x) OVER doy AS m, stddev_samp(x) OVER doy AS s FROM r WINDOW doy AS (PARTITION BY dayofyear(d))), z AS (SELECT d, x, coalesce((x - m) / nullif(s, 0), 0) AS z FROM b),
    q AS (SELECT quantile_cont(z, 0.01) AS lo, quantile_cont(z, 0.99) AS hi FROM z)
    SELECT d, x, round(least(greatest(z, lo), hi), 5) AS z FROM z, q
    """,
)
def dwell_proxy_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes dealt over three years, so that days of the year recur."""
    years = fixes(spark, sf_dir).withColumn("msg_time", F.col("msg_time") + F.make_interval((F.col("mmsi") % 3).cast("int")))
    return rounded(daily.proxy_component(dwell.dwell_windows(years, F.col("sog") < 50), "view").select("d", "x", "z"), "z", digits=5)


HEALTH = f"""
    SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start, count(*) AS messages, count(DISTINCT user_id) AS vessels, round(avg(CAST({K} % 4 = 0 AS INT)), 6) AS tanker_share,
           round(1 - least(count(DISTINCT floor(epoch(ts) / 600)), 36) / 36, 6) AS gap_ratio, round(avg(CAST(value > 95 AS INT)), 6) AS spoof_share FROM events GROUP BY 1
"""


@query("health_windows", HEALTH)
def health_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("mmsi"), F.col("ts").alias("msg_time"), (k() % 4 == 0).alias("is_tanker"), (F.col("value") > 95).alias("spoof"))
    return rounded(daily.health_windows(rows, width_s=21600, bucket_s=600), "tanker_share", "gap_ratio", "spoof_share")


@query(
    "static_messages",
    f"""
    WITH m AS (SELECT *, {K} % 50 + 60 AS c, {K} AS k FROM events WHERE event_type <> 'view')
    SELECT user_id + 200000000 AS mmsi, 'SHIP ' || user_id AS name, CAST(c AS INT) AS shiptype_num, CAST(k % 9 AS INT) AS dimension_a, k % 7 / 2.0::DOUBLE AS draught,
           CASE WHEN c < 100 AND c % 10 IN (0, 1, 2, 3, 4, 9) THEN CASE c // 10 WHEN 6 THEN 'Passenger' WHEN 7 THEN 'Cargo' WHEN 8 THEN 'Tanker' ELSE 'Other' END
           || CASE c % 10 WHEN 0 THEN '' WHEN 1 THEN ' (Hazardous A)' WHEN 2 THEN ' (Hazardous B)' WHEN 3 THEN ' (Hazardous C)' WHEN 4 THEN ' (Hazardous D)' ELSE ' (No additional info)' END
           ELSE 'Type ' || c END AS shiptype_str, count(*) AS n FROM m GROUP BY ALL
    """,
)
def static_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.struct(
        F.concat(F.lit("  SHIP "), F.col("user_id").cast("string"), F.lit(" ")).alias("Name"), (k() % 50 + 60).alias("Type"), F.struct((k() % 9).alias("A")).alias("Dimension"), (k() % 7 / 2).alias("Draught")
    )
    message = F.struct(F.when(F.col("event_type") == "view", 1).otherwise(5).alias("MessageType"), body.alias("ShipStaticData"))
    payload = F.to_json(F.struct(F.struct((F.col("user_id") + 200000000).alias("MMSI")).alias("MetaData"), message.alias("Message")))
    found = static.static_messages(table(spark, sf_dir, "events").select(payload.alias("payload"), F.col("ts").alias("rx_time")))
    return found.groupBy("mmsi", "name", "shiptype_num", "dimension_a", "draught", "shiptype_str").agg(F.count(F.lit(1)).alias("n"))


@query(
    "raw_snapshots",
    """
    WITH l AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS day, o_orderdate AS fetched_at, o_orderstatus || o_orderkey AS payload FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY fetched_at DESC, payload DESC) AS n, count(*) OVER (PARTITION BY k) AS snapshots FROM l)
    SELECT k, fetched_at, payload, snapshots, md5(payload) AS digest FROM r WHERE n = 1
    """,
)
def raw_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("fetched_at"), F.concat("o_orderstatus", F.col("o_orderkey").cast("string")).alias("payload"))
    return static.latest_snapshots(raw, ["k"])


@query(
    "made_up_series",
    """
    WITH r AS (SELECT CAST(i AS INT) AS i, s FROM range(800) a(i), (VALUES ('brent'), ('wti')) b(s))
    SELECT DATE '2022-01-01' + i AS d, s AS series, round(50 + 10 * sin(i * 2 * pi() / 365.25) + CAST('0x' || substr(md5('42|' || s || '|' || i), 1, 6) AS BIGINT) / 16777216.0::DOUBLE, 6) AS value FROM r
    """,
)
def made_up_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(static.made_up_series(spark, ["brent", "wti"], "2022-01-01", 800), "value")


@query(
    "contract_report",
    f"""
    WITH {DAILY}, m AS (SELECT d, sum(n) / 100.0::DOUBLE AS a, CAST(1 AS DOUBLE) AS b FROM day GROUP BY d),
    w AS (SELECT *, CASE WHEN count(a) OVER f >= 10 THEN stddev_samp(a) OVER f END AS sa, CASE WHEN count(b) OVER f >= 10 THEN stddev_samp(b) OVER f END AS sb FROM m
          WINDOW f AS (ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
    SELECT count(*) AS rows, CAST(sum(CASE WHEN a NOT BETWEEN -8 AND 8 THEN 1 ELSE 0 END) AS BIGINT) AS outside, count(*) - count(DISTINCT d) AS repeated_dates,
           CAST(CASE WHEN max(sa) = 0 THEN 1 ELSE 0 END + CASE WHEN max(sb) = 0 THEN 1 ELSE 0 END AS INT) AS standing_still, false AS valid FROM w
    """,
)
def contract_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix with one series that stands still, which the contract must tell."""
    rows = day_series(spark, sf_dir).groupBy("d").agg((F.sum("n") / 100.0).alias("a")).withColumn("b", F.lit(1.0))
    return daily.contract(rows, "d", ["a", "b"])


@query(
    "spread_dataset",
    f"""
    WITH {DAILY}, f AS (SELECT d, k, n, x, CAST(n AS DOUBLE) AS c, lag(n, 1) OVER w AS l1, lag(n, 5) OVER w AS l5, lag(x, 1) OVER w AS s1, lag(x, 5) OVER w AS s5, lead(x) OVER w AS nx,
        CASE WHEN count(n) OVER v >= 3 AND stddev_samp(n) OVER v <> 0 THEN (n - avg(n) OVER v) / stddev_samp(n) OVER v END AS z7
        FROM day WINDOW w AS (PARTITION BY k ORDER BY d), v AS (PARTITION BY k ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
    SELECT d, k, coalesce(CAST(l1 AS DOUBLE), 0) AS lag_1, coalesce(c - l5, 0) AS chg_5, round(coalesce(z7, 0), 5) AS z_7, round(coalesce((x - s1) / s1, 0), 6) AS spread_ret_1,
           round(coalesce((x - s5) / s5, 0), 6) AS spread_ret_5, CAST(isodow(d) - 1 AS INT) AS weekday, CAST(isodow(d) = 1 AS INT) AS is_mon, CAST(isodow(d) = 5 AS INT) AS is_fri, CAST(week(d) AS INT) AS week, round(sin(dayofyear(d) * 2 * pi() / 365.25), 6) AS doy_sin,
           CASE WHEN nx - x > 0.0005 THEN 1 ELSE 0 END AS target FROM f
    """,
)
def spread_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = day_series(spark, sf_dir).select("d", "k", F.col("n").cast("double").alias("c"), F.col("x").alias("spread"))
    out = daily.spread_dataset(rows, ["k"], "d", "c", "spread").select("d", "k", "lag_1", "chg_5", "z_7", "spread_ret_1", "spread_ret_5", "weekday", "is_mon", "is_fri", "week", "doy_sin", "target")
    return rounded(rounded(out, "z_7", digits=5), "spread_ret_1", "spread_ret_5", "doy_sin")


@query(
    "sea_state_component",
    """
    WITH s AS (SELECT CAST(l_shipdate AS DATE) AS d, l_returnflag AS k, avg(l_quantity) AS x, avg(-(l_discount * cos(0.5) + l_tax * sin(0.5))) AS opposing FROM lineitem GROUP BY 1, 2),
    b AS (SELECT *, avg(x) OVER doy AS m, stddev_samp(x) OVER doy AS sd FROM s WINDOW doy AS (PARTITION BY k, dayofyear(d)))
    SELECT d, k, round(x, 5) AS x, round(opposing, 6) AS opposing, round(coalesce((x - m) / nullif(sd, 0), 0), 4) AS z FROM b
    """,
)
def sea_state_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "lineitem").select("l_shipdate", F.col("l_returnflag").alias("k"), F.col("l_quantity").alias("hs"), F.col("l_discount").alias("u"), F.col("l_tax").alias("v"))
    out = daily.sea_state_component(samples, ["k"], "l_shipdate", "hs", "u", "v", 0.5).select("d", "k", "x", "opposing", "z")
    return rounded(rounded(rounded(out, "x", digits=5), "opposing"), "z", digits=4)


SPREAD_FEATURES = ["lag_1", "lag_3", "lag_5", "chg_1", "chg_3", "chg_5", "z_7", "z_14", "spread_ret_1", "spread_ret_5", "weekday", "month", "doy_sin", "doy_cos"]


@query("direction_reliability")
def direction_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the spread rose where the calibrated model said so; models can't be fitted in SQL."""
    rows = day_series(spark, sf_dir).select("d", "k", F.col("n").cast("double").alias("c"), F.col("x").alias("spread"))
    features = cut(daily.spread_dataset(rows, ["k"], "d", "c", "spread"))
    scored = models.out_of_fold(features, SPREAD_FEATURES)
    return rounded(models.reliability(models.calibrated(models.calibrator(scored), scored)), "predicted", "observed")


#: What a published signal must look like.
SIGNALS_SCHEMA = {
    "type": "object",
    "required": ["asof", "index", "change"],
    "properties": {
        "asof": {"type": "string", "format": "date-time"},
        "index": {"type": "number"},
        "change": {"type": ["number", "null"]},
        "direction": {
            "type": ["object", "null"], "required": ["prob_up", "top_decile"], "additionalProperties": False,
            "properties": {"prob_up": {"type": "number", "minimum": 0.0, "maximum": 1.0}, "top_decile": {"type": "boolean"}},
        },
        "nowcast": {"type": "object", "patternProperties": {"^[0-9]{4}-[0-9]{2}-[0-9]{2}$": {"type": "number"}}, "additionalProperties": False, "minProperties": 1},
        "annotations": {"type": "array", "items": {"type": "string"}},
    },
    "additionalProperties": False,
}


@query(
    "signal_violations",
    f"""
    WITH {DAILY}
    SELECT k, d, array_to_string(list_sort(list_filter([
        CASE WHEN n % 5 = 0 THEN '$: change missing' END, CASE WHEN n % 7 = 0 THEN '$: extra not allowed' END, CASE WHEN n % 3 = 0 THEN '$.direction.prob_up: beyond maximum' END,
        CASE WHEN n % 4 = 0 THEN '$.direction: top_decile missing' END, CASE WHEN n % 11 = 0 THEN '$.index: not number' END,
        CASE WHEN n % 6 = 0 THEN '$.nowcast: too few members' END, CASE WHEN n % 6 = 1 THEN '$.nowcast: soon not allowed' END, CASE WHEN n % 10 = 1 THEN '$.annotations[]: not string' END
    ], lambda x: x IS NOT NULL)), '; ') AS violations FROM day
    """,
)
def signal_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals made of daily series, each broken by what its count says."""
    n = F.col("n")
    direction = F.concat(
        F.lit('{"prob_up": '), F.when(n % 3 == 0, "1.5").otherwise("0.5"), F.when(n % 4 == 0, "").otherwise(', "top_decile": true'), F.lit("}")
    )
    nowcast = F.when(n % 6 == 0, "{}").when(n % 6 == 1, '{"2024-01-01": 1, "soon": 2}').otherwise('{"2024-01-01": 1.5}')
    text = F.concat(
        F.lit('{"asof": "'), F.col("d").cast("string"), F.lit('", "index": '), F.when(n % 11 == 0, '"high"').otherwise(n.cast("string")), F.when(n % 5 == 0, "").otherwise(', "change": null'),
        F.when(n % 7 == 0, ', "extra": 1').otherwise(""), F.lit(', "direction": '), direction, F.lit(', "nowcast": '), nowcast, F.lit(', "annotations": ["a"'), F.when(n % 10 == 1, ", 2, 3").otherwise(""), F.lit("]}"),
    )
    found = contracts.with_violations(day_series(spark, sf_dir).select("k", "d", text.alias("signal")), SIGNALS_SCHEMA, "signal")
    return found.select("k", "d", F.array_join("violations", "; ").alias("violations"))


@query(
    "matrix_violations",
    f"""
    WITH {DAILY}, m AS (SELECT d, sum(n) AS n, sum(x) AS x FROM day GROUP BY d), s AS (SELECT *, row_number() OVER (ORDER BY d) AS i FROM m),
    r AS (SELECT i, CASE WHEN i % 50 = 0 THEN d - INTERVAL 3 DAY ELSE d END AS d, CASE WHEN n % 9 = 0 THEN NULL ELSE n - 20.0::DOUBLE END AS a, CASE WHEN n % 9 = 1 THEN NULL ELSE 1.0 END AS b FROM s),
    o AS (SELECT *, max(d) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r)
    SELECT CAST(d AS DATE) AS d, 'a' AS column, 'missing' AS problem FROM o WHERE a IS NULL
    UNION ALL SELECT CAST(d AS DATE), 'a', 'outside its bounds' FROM o WHERE a NOT BETWEEN -8 AND 8
    UNION ALL SELECT CAST(d AS DATE), 'd', 'not after the dates before' FROM o WHERE d <= before
    """,
)
def matrix_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell of a matrix of days that breaks the contract; every fiftieth date is set back."""
    from pyspark.sql import Window

    days = day_series(spark, sf_dir).groupBy("d").agg(F.sum("n").alias("n")).withColumn("i", F.row_number().over(Window.orderBy("d")))
    rows = days.select(
        "i", F.when(F.col("i") % 50 == 0, F.date_sub("d", 3)).otherwise(F.col("d")).alias("d"), F.when(F.col("n") % 9 != 0, F.col("n") - 20.0).alias("a"), F.when(F.col("n") % 9 != 1, 1.0).alias("b")
    )
    return contracts.matrix_report(rows, "d", "i", ["a"], ["b"])
