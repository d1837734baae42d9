"""View queries on the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.storage import new_path
from tideline.functions.tables import table
from tideline.operators import flux, indices, registry, views
from tideline.plans.flow_queries import GATED, crossings, moves, rounded
from tideline.plans.registry import query
from tideline.plans.series_queries import COMPONENTS, components
from tideline.sources import readers, versions


@query(
    "latest_occupancy",
    """
    WITH o AS (SELECT date_trunc('hour', ts) AS ts, event_type AS polygon_id, count(DISTINCT user_id) AS count_now FROM events GROUP BY ALL)
    SELECT ts, polygon_id, count_now FROM o WHERE ts = (SELECT max(ts) FROM o)
    """,
)
def latest_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = moves(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").alias("ts"), "polygon_id").agg(F.countDistinct("mmsi").alias("count_now"))
    return views.at_latest(rows, "ts")


@query(
    "gate_flux_series",
    f"""
    WITH {GATED}, h AS (SELECT date_trunc('hour', ts) AS ts, gate_id, direction, count(*) AS crossings FROM g GROUP BY ALL),
    r AS (SELECT * FROM (SELECT *, max(ts) OVER (PARTITION BY gate_id) AS m FROM h) WHERE ts > m - INTERVAL 24 HOURS)
    SELECT ts, gate_id, direction, crossings, CAST(sum(crossings) OVER (PARTITION BY gate_id) AS BIGINT) AS total FROM r
    """,
)
def gate_flux_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.anchored_series(flux.hourly_flux(crossings(spark, sf_dir)), "gate_id", "ts", "crossings", 24)


@query(
    "alerts_newest",
    "SELECT event_id, ts, user_id, value FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 500",
)
def alerts_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "ts", "user_id", "value")
    return views.newest_first(rows, "ts", ["event_id"], limit=900)


@query(
    "index_tail",
    f"""
    WITH {COMPONENTS}, b AS (SELECT d, basin, 100 * exp(avg(z_value)) AS level, count(z_value) AS present FROM comp GROUP BY ALL)
    SELECT d, basin, round(level, 4) AS level, present FROM b WHERE d >= (SELECT max(d) FROM b) - 29
    """,
)
def index_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.operators.indices import basin_index

    return rounded(views.tail_days(basin_index(components(spark, sf_dir)), "d", 30), "level", digits=4)


@query(
    "latest_impact",
    """
    WITH s AS (SELECT CAST(l_shipdate AS DATE) AS ds, l_returnflag AS corridor_id, max(l_discount) AS p FROM lineitem GROUP BY ALL),
    k AS (SELECT * FROM s WHERE ds >= (SELECT max(ds) FROM s) - 13)
    SELECT corridor_id, max(ds) AS ds, round(arg_max(p, ds), 6) AS sis_p90 FROM k GROUP BY corridor_id
    """,
)
def latest_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("ds"), F.col("l_returnflag").alias("corridor_id")).agg(F.max("l_discount").alias("sis_p90"))
    return rounded(views.latest_known(daily, "corridor_id", "ds", "sis_p90", 14), "sis_p90")


@query(
    "weather_flag_max",
    """
    WITH u AS (
        SELECT CAST(l_shipdate AS DATE) AS d, l_returnflag AS region, l_quantity >= 49 AS f FROM lineitem
        UNION ALL SELECT CAST(l_shipdate AS DATE), l_linestatus, l_tax >= 0.08 FROM lineitem
        UNION ALL SELECT CAST(o_orderdate AS DATE), o_orderstatus, o_totalprice > 400000 FROM orders)
    SELECT d, region, bool_or(f) AS weather_flag FROM u GROUP BY ALL
    """,
)
def weather_flag_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")

    def flags(df: DataFrame, d: str, region: str, flag: str) -> DataFrame:
        return df.select(F.to_date(d).alias("d"), F.col(region).alias("region"), F.expr(flag).alias("weather_flag"))

    sources = [
        flags(lines, "l_shipdate", "l_returnflag", "l_quantity >= 49"), flags(lines, "l_shipdate", "l_linestatus", "l_tax >= 0.08D"),
        flags(orders, "o_orderdate", "o_orderstatus", "o_totalprice > 400000"),
    ]
    return views.flag_union(sources, ["d", "region"], "weather_flag")


@query(
    "region_pivot",
    """
    SELECT CAST(ts AS DATE) AS d, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS view, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS click,
           count(*) AS total FROM events GROUP BY 1
    """,
)
def region_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = moves(spark, sf_dir).select(F.to_date("ts").alias("d"), F.col("event").alias("region"), F.lit(1).alias("n"))
    return views.region_pivot(rows, "d", "region", ["view", "click"], "n")


@query(
    "corridor_traffic",
    """
    WITH m(polygon_id, corridor_id) AS (VALUES ('view', 'EAST'), ('click', 'EAST'), ('click', 'WEST'), ('purchase', 'WEST'))
    SELECT corridor_id, count(*) AS events, count(DISTINCT user_id) AS vessels, count(DISTINCT m.polygon_id) AS polygons FROM events JOIN m ON m.polygon_id = event_type GROUP BY 1
    """,
)
def corridor_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = spark.createDataFrame([("view", ["EAST"]), ("click", ["EAST", "WEST"]), ("purchase", ["WEST"])], "polygon_id string, corridors array<string>")
    return views.corridor_traffic(moves(spark, sf_dir), mapping)


@query(
    "area_stats",
    """
    SELECT CAST(l_shipdate AS DATE) AS d, round(avg(l_quantity) FILTER (l_quantity < 48), 6) AS hs_mean, round(quantile_cont(l_quantity, 0.9) FILTER (l_quantity < 48), 6) AS hs_p90,
           round(quantile_cont(l_quantity, 0.95) FILTER (l_quantity < 48), 6) AS hs_p95 FROM lineitem GROUP BY 1
    """,
)
def area_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("l_quantity") < 48, F.col("l_quantity").cast("double")).otherwise(float("nan"))
    grid = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("d"), value.alias("hs"))
    return rounded(views.area_stats(grid, ["d"], "hs"), "hs_mean", "hs_p90", "hs_p95")


@query(
    "value_histogram",
    "SELECT CAST(least(greatest(floor((value - 10) / 8.0), 0), 9) AS INT) AS bin, count(*) AS n FROM events GROUP BY 1",
)
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.histogram(table(spark, sf_dir, "events"), "value", 10.0, 90.0, 10)


@query("distinct_places", "SELECT DISTINCT round(l_quantity + l_discount / 3, 2) AS lat, round(l_tax * 7, 2) AS lon FROM lineitem")
def distinct_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") + F.col("l_discount") / 3).alias("a"), (F.col("l_tax") * 7).alias("b"))
    return views.distinct_places(rows, "a", "b", digits=2)


@query(
    "gauge_zones",
    """
    WITH d AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT d, n, least(greatest(n / (SELECT avg(n) FROM d) * 100, 0), 200) AS ratio FROM d)
    SELECT d, n, round(ratio, 6) AS ratio, CASE WHEN ratio < 80 THEN 'low' WHEN ratio < 120 THEN 'normal' WHEN ratio < 150 THEN 'elevated' ELSE 'high' END AS zone FROM r
    """,
)
def gauge_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    joined = daily.join(F.broadcast(daily.agg(F.avg("n").alias("m"))))
    ratio, zone = views.gauge(F.col("n"), F.col("m"))
    return rounded(joined.select("d", "n", ratio.alias("ratio"), zone.alias("zone")), "ratio")


@query(
    "index_readiness",
    "SELECT max(CAST(ts AS DATE)) AS latest, CAST(date_diff('day', max(CAST(ts AS DATE)), DATE '2024-02-03') AS INT) AS age_days, date_diff('day', max(CAST(ts AS DATE)), DATE '2024-02-03') <= 2 AS ready FROM events",
)
def index_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = moves(spark, sf_dir).select(F.to_date("ts").alias("d"))
    return views.readiness(rows, "d", F.lit("2024-02-03").cast("date"))


@query(
    "signal_sea_state",
    """
    WITH n AS (SELECT ts, max(value) AS hs FROM events GROUP BY ts ORDER BY ts DESC LIMIT 1)
    SELECT n.ts, n.hs, round(avg(value / 10), 6) AS opposing_mean FROM n JOIN events e ON CAST(e.ts AS DATE) = CAST(n.ts AS DATE) GROUP BY ALL
    """,
)
def signal_sea_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = moves(spark, sf_dir).select("ts", F.col("sog").alias("hs"), (F.col("sog") / 10).alias("opposing"))
    return rounded(views.day_opposing(rows), "opposing_mean")


@query(
    "vessel_exports",
    """
    SELECT event_type AS polygon_id, CAST(ts AS DATE) AS ds, count(*) AS events, count(DISTINCT user_id) AS vessels, min(ts) AS first_ts, max(ts) AS last_ts
    FROM events WHERE ts > TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '2024-01-31' GROUP BY ALL
    """,
)
def vessel_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.operators.dwell import recent

    rows = recent(moves(spark, sf_dir), "ts", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'"), F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'"))
    return rows.groupBy("polygon_id", F.to_date("ts").alias("ds")).agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("mmsi").alias("vessels"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


@query(
    "range_replaced",
    """
    WITH r AS (
        SELECT ts, event_type, value, false AS again FROM events WHERE NOT (ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-10 12:00:00') OR ts IS NULL
        UNION ALL SELECT ts, event_type, value + 1000, true FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-10 12:00:00'
    )
    SELECT CAST(ts AS DATE) AS d, event_type, again, count(*) AS n, round(sum(value), 4) AS total FROM r GROUP BY ALL
    """,
)
def range_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events published as a table, half a day of them replaced, and the new version read back."""
    rows = table(spark, sf_dir, "events").select("ts", "event_type", "value", F.lit(False).alias("again"))
    path, half = new_path(spark, "events"), ("2024-01-10 00:00:00", "2024-01-10 12:00:00")
    versions.publish(rows.repartitionByRange("ts"), path, "ts")
    inside = (F.col("ts") >= F.lit(half[0]).cast("timestamp_ntz")) & (F.col("ts") < F.lit(half[1]).cast("timestamp_ntz"))
    versions.replace_range(rows.where(inside).withColumns({"value": F.col("value") + 1000, "again": F.lit(True)}), path, *half)
    found = versions.read_version(spark, path)
    return found.groupBy(F.to_date("ts").alias("d"), "event_type", "again").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


SEA_DAILY = """
    day AS (SELECT l_returnflag || '->' || l_linestatus AS corridor_id, CAST(l_shipdate AS DATE) AS ds, round(avg(l_discount), 6) AS score_mean, round(quantile_cont(l_quantity, 0.9), 6) AS wave_p90, count(*) AS n_samples
            FROM lineitem GROUP BY ALL)
"""


@query("corridor_series", f"WITH {SEA_DAILY}, m AS (SELECT *, max(ds) OVER (PARTITION BY corridor_id) AS newest FROM day) SELECT corridor_id, ds, score_mean, wave_p90, n_samples, ds = newest AS latest FROM m WHERE ds >= newest - 6")
def corridor_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last week of each corridor's daily scores, counted back from its own newest day."""
    name = F.concat("l_returnflag", F.lit("->"), "l_linestatus").alias("corridor_id")
    days = table(spark, sf_dir, "lineitem").groupBy(name, F.to_date("l_shipdate").alias("ds")).agg(
        F.avg("l_discount").alias("score_mean"), F.percentile("l_quantity", F.lit(0.9)).alias("wave_p90"), F.count(F.lit(1)).alias("n_samples")
    )
    return views.series_of_days(rounded(days, "score_mean", "wave_p90"), ["corridor_id"], "ds", 7)


@query(
    "index_export",
    f"""
    WITH {COMPONENTS}, b AS (SELECT d, basin, round(100 * exp(avg(z_value)), 4) AS value, count(z_value) AS present FROM comp GROUP BY ALL)
    SELECT basin, strftime(d, '%Y-%m-%d') AS date, value, CAST(present AS INT) AS present FROM b QUALIFY row_number() OVER (PARTITION BY basin ORDER BY d DESC) <= 90
    """,
)
def index_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 90 days of each basin's index, exported as CSV and read back."""
    level = rounded(indices.basin_index(components(spark, sf_dir)), "level", digits=4)
    rows = views.last_rows(level, ["basin"], "d", 90).select("basin", F.col("d").cast("string").alias("date"), F.col("level").alias("value"), F.col("present").cast("int").alias("present"))
    path = f"{new_path(spark, 'index')}.csv"
    readers.export_csv(rows, path, ["basin", "date"])
    return readers.read_table(spark, path, "basin string, date string, value double, present int")


VISITS = "v AS (SELECT event_type AS polygon_id, CASE WHEN user_id % 3 = 0 THEN 'sts' ELSE 'terminal' END AS kind, user_id AS mmsi, ts AS ts_in, CAST(floor(value) AS BIGINT) AS dwell_min FROM events)"


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("polygon_id"), F.when(F.col("user_id") % 3 == 0, "sts").otherwise("terminal").alias("kind"), F.col("user_id").alias("mmsi"), F.col("ts").alias("ts_in"), F.floor("value").alias("dwell_min")
    )


@query(
    "busiest_places",
    f"""
    WITH {VISITS} SELECT polygon_id, kind, count(*) AS visits, round(sum(dwell_min) / 60, 1) AS dwell_hours, count(DISTINCT mmsi) AS vessels FROM v
    WHERE ts_in BETWEEN TIMESTAMP '2024-01-18 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00' GROUP BY ALL ORDER BY visits DESC, polygon_id, kind LIMIT 10
    """,
)
def busiest_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.busiest_places(visits(spark, sf_dir), F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"))


@query(
    "recent_visits",
    f"""
    WITH {VISITS} SELECT count(*) AS visits, count(DISTINCT mmsi) AS vessels, CAST(coalesce(sum(dwell_min), 0) AS BIGINT) AS dwell_min FROM v
    WHERE ts_in BETWEEN TIMESTAMP '2024-01-24 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00'
    """,
)
def recent_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.recent_visits(visits(spark, sf_dir), F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"))


@query(
    "canonical_fixes",
    """
    SELECT user_id % 100 AS mmsi, date_trunc('hour', ts) AS msg_time, value AS sog, event_id AS received FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id % 100, date_trunc('hour', ts) ORDER BY ts DESC, event_id DESC) = 1
    """,
)
def canonical_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the raw messages with one vessel and time the one received last."""
    raw = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 100).alias("mmsi"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("msg_time"), F.col("value").alias("sog"), F.col("event_id").alias("received"), "ts"
    )
    return registry.latest_row(raw, ["mmsi", "msg_time"], ["ts", "received"]).drop("ts")
