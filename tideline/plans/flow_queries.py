"""Queries on events: dwell, flux and transits.

The shared tables hold no vessels, so ``events`` stands for them: a user is a vessel, an event type a region, gate
or polygon, ``value`` a speed, and ``props.k`` deals directions and bands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.tables import table
from tideline.operators import dwell, flux, transit
from tideline.plans.registry import query

AS_OF = "TIMESTAMP_NTZ '2024-01-25 00:00:00'"
K = "CAST(json_extract_string(props, '$.k') AS INT)"
GATED = f"""
    g AS (
        SELECT ts, user_id AS mmsi, 'GATE_' || upper(event_type) || '_' || CAST(({K} % 3 + 1) * 10 AS VARCHAR) || 'NM' AS gate_id,
               CASE WHEN {K} % 2 = 0 THEN 'AtoB' ELSE 'BtoA' END AS direction, value
        FROM events
    )
"""


def k():
    return F.get_json_object("props", "$.k").cast("int")


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as fixes: mmsi, msg_time, rx_time, region, sog."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("mmsi"),
        F.col("ts").alias("msg_time"),
        F.col("event_id").alias("rx_time"),
        F.col("event_type").alias("region"),
        F.col("value").alias("sog"),
    )


def crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as gate crossings: ts, mmsi, gate_id with band, direction."""
    band = F.concat(F.lit("GATE_"), F.upper("event_type"), F.lit("_"), ((k() % 3 + 1) * 10).cast("string"), F.lit("NM"))
    return table(spark, sf_dir, "events").select(
        "ts", F.col("user_id").alias("mmsi"), band.alias("gate_id"), F.when(k() % 2 == 0, "AtoB").otherwise("BtoA").alias("direction"), "value"
    )


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as polygon events: mmsi, ts, event, polygon_id and gate_id (the type)."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("mmsi"), "ts", kind.alias("event"), kind.alias("gate_id"), kind.alias("polygon_id"), F.col("value").alias("sog")
    )


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """The columns rounded; adding 0 turns a negative zero into zero."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in names})


@query(
    "dwell_10m",
    """
    WITH d AS (
        SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts DESC, event_id DESC) AS n FROM events
    )
    SELECT time_bucket(INTERVAL '10 minutes', ts) AS window_start, event_type AS region,
           count(DISTINCT CASE WHEN value < 50 THEN user_id END) AS slow_count
    FROM d WHERE n = 1 GROUP BY ALL
    """,
)
def dwell_10m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dwell.dwell_windows(dwell.latest_per_minute(fixes(spark, sf_dir)), F.col("sog") < 50)


@query(
    "gap_sessions",
    """
    WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
    s AS (SELECT *, sum(CASE WHEN epoch(ts) - epoch(p) > 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM l)
    SELECT user_id AS mmsi, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n,
           round((epoch(max(ts)) - epoch(min(ts))) / 60.0, 4) AS minutes
    FROM s GROUP BY user_id, k HAVING epoch(max(ts)) - epoch(min(ts)) >= 3600
    """,
)
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dwell.gap_sessions(moves(spark, sf_dir), ["mmsi"]), "minutes", digits=4)


@query(
    "visits_daily",
    """
    SELECT CAST(ts AS DATE) AS ds, event_type AS polygon_id, count(*) AS visits, count(DISTINCT user_id) AS vessels,
           CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS dwell_min
    FROM events GROUP BY ALL
    """,
)
def visits_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = moves(spark, sf_dir).select("mmsi", "polygon_id", F.col("ts").alias("ts_in"), F.floor("sog").alias("dwell_min"))
    return dwell.visits_daily(visits)


@query(
    "daily_dwell",
    """
    WITH v AS (
        SELECT CAST(l_shipdate AS DATE) AS ds, o_orderpriority AS polygon_id,
               (epoch(l_shipdate) - epoch(o_orderdate)) / 3600.0 AS h
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity <= 10
    )
    SELECT ds, polygon_id, median(h) AS p50_h, quantile_disc(h, 0.9) AS p90_h, count(*) AS n FROM v GROUP BY ALL
    """,
)
def daily_dwell(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    visits = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_orderpriority").alias("polygon_id"),
        F.col("o_orderdate").alias("enter_ts"),
        F.col("l_shipdate").alias("exit_ts"),
        F.col("l_quantity").alias("sog_avg"),
        F.lit(None).cast("double").alias("sog_max"),
        F.lit(None).cast("double").alias("sog_min"),
    )
    return dwell.daily_dwell(visits, slow_below=10.0)


@query(
    "occupancy_now",
    """
    WITH p AS (SELECT user_id, event_type, max(ts) AS seen FROM events WHERE ts <= TIMESTAMP '2024-01-25' GROUP BY ALL)
    SELECT event_type AS polygon_id, count(*) AS count_now FROM p
    WHERE user_id % 3 <> 0 AND seen >= TIMESTAMP '2024-01-25' - INTERVAL 600 MINUTES GROUP BY ALL
    """,
)
def occupancy_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.expr(AS_OF)
    presence = (
        moves(spark, sf_dir).where(F.col("ts") <= as_of).groupBy("mmsi", "polygon_id").agg(F.max("ts").alias("last_seen_ts"))
    ).withColumn("inside", F.col("mmsi") % 3 != 0)
    return dwell.occupancy_now(presence, as_of, minutes=600)


@query(
    "polygon_entries_daily",
    "SELECT CAST(ts AS DATE) AS ds, event_type AS polygon_id, count(*) AS entries FROM events GROUP BY ALL",
)
def polygon_entries_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dwell.daily_entries(moves(spark, sf_dir).withColumnRenamed("ts", "enter_ts"))


@query(
    "hourly_vessels",
    """
    SELECT date_trunc('hour', ts) AS hour, event_type AS polygon_id, count(DISTINCT user_id) AS vessels FROM events GROUP BY ALL
    """,
)
def hourly_vessels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dwell.hourly_vessels(moves(spark, sf_dir))


@query(
    "anchorage_now",
    """
    WITH l AS (
        SELECT user_id, event_type, ts, value,
               row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS n FROM events
    )
    SELECT event_type AS polygon_id, count(*) AS vessels, min(ts) AS longest_since FROM l WHERE n = 1 AND value < 50 GROUP BY ALL
    """,
)
def anchorage_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = moves(spark, sf_dir).withColumn("event", F.when(F.col("sog") < 50, "enter").otherwise("exit"))
    return dwell.anchorage_now(events)


@query(
    "gate_flux_hourly",
    f"WITH {GATED} SELECT date_trunc('hour', ts) AS ts, gate_id, direction, count(*) AS crossings FROM g GROUP BY ALL",
)
def gate_flux_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flux.hourly_flux(crossings(spark, sf_dir))


@query(
    "gate_flux_daily",
    f"WITH {GATED} SELECT CAST(ts AS DATE) AS ds, gate_id, direction, count(*) AS crossings FROM g GROUP BY ALL",
)
def gate_flux_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flux.daily_flux(crossings(spark, sf_dir))


@query(
    "gate_flux_rolling",
    f"""
    WITH {GATED}
    SELECT '24h' AS window_label, gate_id, direction, count(*) AS crossings FROM g
    WHERE ts > TIMESTAMP '2024-01-24' AND ts <= TIMESTAMP '2024-01-25' GROUP BY ALL
    UNION ALL
    SELECT '7d', gate_id, direction, count(*) FROM g
    WHERE ts > TIMESTAMP '2024-01-18' AND ts <= TIMESTAMP '2024-01-25' GROUP BY ALL
    """,
)
def gate_flux_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flux.rolling_flux(crossings(spark, sf_dir), F.expr(AS_OF))


@query(
    "gate_flux_dedup",
    f"""
    WITH {GATED}, c AS (
        SELECT gate_id FROM (
            SELECT gate_id, row_number() OVER (PARTITION BY regexp_replace(gate_id, '_[0-9]+NM$', '')
                ORDER BY CAST(regexp_extract(gate_id, '_([0-9]+)NM$', 1) AS INT) DESC, gate_id) AS n
            FROM (SELECT DISTINCT gate_id FROM g)) WHERE n = 1
    ), r(gate_id, h) AS (VALUES ('GATE_CLICK_30NM', 12.0), ('GATE_VIEW_30NM', 3.0)),
    b AS (
        SELECT CAST(ts AS DATE) AS ds, g.gate_id, direction, mmsi,
               floor(epoch(ts) / (CAST(coalesce(h, 6.0) AS DOUBLE) * 3600.0)) AS bucket
        FROM g JOIN c USING (gate_id) LEFT JOIN r USING (gate_id)
    ), o AS (SELECT ds, gate_id, direction, mmsi, count(DISTINCT bucket) AS n FROM b GROUP BY ALL)
    SELECT ds, gate_id, direction, CAST(sum(n) AS BIGINT) AS crossings, count(*) AS distinct_vessels FROM o GROUP BY ALL
    """,
)
def gate_flux_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rehit = spark.createDataFrame([("GATE_CLICK_30NM", 12.0), ("GATE_VIEW_30NM", 3.0)], "gate_id string, rehit_hours double")
    return flux.deduplicated_flux(crossings(spark, sf_dir), rehit)


@query(
    "gate_baseline",
    f"""
    WITH {GATED}, d AS (SELECT CAST(ts AS DATE) AS ds, gate_id, count(*) AS crossings FROM g GROUP BY ALL)
    SELECT gate_id, round(avg(crossings), 6) AS mean, round(stddev_pop(crossings), 6) AS std,
           array_to_string(list(crossings ORDER BY ds)[-7:], ',') AS trend
    FROM d GROUP BY gate_id
    """,
)
def gate_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = crossings(spark, sf_dir).groupBy(F.to_date("ts").alias("ds"), "gate_id").agg(F.count(F.lit(1)).alias("crossings"))
    base = rounded(flux.gate_baseline(daily), "mean", "std")
    return base.withColumn("trend", F.array_join(F.col("trend").cast("array<string>"), ","))


@query(
    "hour_share_peaks",
    """
    WITH c AS (SELECT event_type AS gate_id, hour(ts) AS hour, count(*) AS n FROM events GROUP BY ALL),
    s AS (SELECT *, n / sum(n) OVER (PARTITION BY gate_id) AS share FROM c),
    q AS (SELECT *, quantile_cont(share, 0.9) OVER (PARTITION BY gate_id) AS cut FROM s)
    SELECT gate_id, CAST(hour AS INT) AS hour, n, round(share, 9) AS share, round(cut, 9) AS cut, share >= cut AS peak FROM q
    """,
)
def hour_share_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(flux.hour_share(moves(spark, sf_dir)), "share", "cut", digits=9)


@query(
    "route_share",
    """
    WITH d AS (SELECT CAST(ts AS DATE) AS ds, event_type AS gate_id, count(*) AS n FROM events GROUP BY ALL),
    s AS (
        SELECT sum(CASE WHEN gate_id = 'click' AND ds > DATE '2024-01-22' THEN n ELSE 0 END) AS a,
               sum(CASE WHEN gate_id = 'view' AND ds > DATE '2024-01-22' THEN n ELSE 0 END) AS b,
               sum(CASE WHEN gate_id = 'click' AND ds <= DATE '2024-01-22' AND ds > DATE '2024-01-07' THEN n ELSE 0 END) AS c,
               sum(CASE WHEN gate_id = 'view' AND ds <= DATE '2024-01-22' AND ds > DATE '2024-01-07' THEN n ELSE 0 END) AS d
        FROM d
    )
    SELECT CAST(a AS BIGINT) AS recent_crossings, round(a / (a + b), 6) AS recent_share, round(c / (c + d), 6) AS baseline_share FROM s
    """,
)
def route_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = moves(spark, sf_dir).groupBy(F.to_date("ts").alias("ds"), "gate_id").agg(F.count(F.lit(1)).alias("crossings"))
    return rounded(flux.route_share(daily, "click", "view", F.lit("2024-01-25").cast("date")), "recent_share", "baseline_share")


@query(
    "chokepoint_summary",
    f"""
    WITH {GATED}, d AS (SELECT CAST(ts AS DATE) AS ds, gate_id, count(*) AS n FROM g GROUP BY ALL),
    b AS (SELECT gate_id, avg(n) AS mean, stddev_pop(n) AS std FROM d GROUP BY gate_id),
    f AS (SELECT gate_id, count(*) AS flux FROM g WHERE date_trunc('hour', ts) > TIMESTAMP '2024-01-24'
          AND date_trunc('hour', ts) <= TIMESTAMP '2024-01-25' GROUP BY gate_id)
    SELECT f.gate_id, flux, round(mean, 6) AS mean, round(std, 6) AS std,
           round(CASE WHEN std > 0 THEN (flux - mean) / std END, 6) AS z, round(flux / mean, 6) AS ratio
    FROM f LEFT JOIN b USING (gate_id)
    """,
)
def chokepoint_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = crossings(spark, sf_dir)
    daily = rows.groupBy(F.to_date("ts").alias("ds"), "gate_id").agg(F.count(F.lit(1)).alias("crossings"))
    summary = flux.chokepoint_summary(flux.hourly_flux(rows), flux.gate_baseline(daily), F.expr(AS_OF))
    return rounded(summary, "mean", "std", "z", "ratio")


NEXT_SQL = """
    n AS (
        SELECT e.user_id AS mmsi, e.event_type AS from_id, e.ts AS entry_ts, x.ts AS exit_ts, x.event_type AS to_id,
               (epoch(x.ts) - epoch(e.ts)) / 3600.0 AS hours
        FROM events e, LATERAL (
            SELECT ts, event_type FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts > e.ts
              AND epoch(p.ts) - epoch(e.ts) <= 48 * 3600 ORDER BY ts LIMIT 1
        ) x WHERE e.event_type = 'click'
    )
"""


def _next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transit.next_match(moves(spark, sf_dir), F.col("event") == "click", F.col("event") == "purchase")


@query(
    "next_match_transit",
    f"WITH {NEXT_SQL} SELECT mmsi, from_id, entry_ts, exit_ts, to_id, round(hours, 6) AS hours FROM n",
)
def next_match_transit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_next(spark, sf_dir), "hours")


@query(
    "gate_transit_stats",
    f"""
    WITH {NEXT_SQL} SELECT CAST(entry_ts AS DATE) AS ds, from_id, to_id, round(median(hours), 6) AS median_h,
        round(avg(hours), 6) AS mean_h, round(quantile_disc(hours, 0.9), 6) AS p90_h, count(*) AS n FROM n GROUP BY ALL
    """,
)
def gate_transit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _next(spark, sf_dir).withColumn("ds", F.to_date("entry_ts"))
    return rounded(transit.transit_stats(found, ["ds", "from_id", "to_id"]), "median_h", "mean_h", "p90_h")


@query(
    "paired_transits",
    f"""
    WITH {NEXT_SQL}, s AS (
        SELECT CAST(entry_ts AS DATE) AS ds, from_id, to_id, median(hours) AS median_h, avg(hours) AS mean_h,
               quantile_disc(hours, 0.9) AS p90_h, count(*) AS n FROM n GROUP BY ALL
    )
    SELECT from_id, to_id, round(sum(mean_h * n) / nullif(sum(n), 0), 6) AS mean_h,
           round(sum(median_h * n) / nullif(sum(n), 0), 6) AS median_h, round(max(p90_h), 6) AS p90_h, CAST(sum(n) AS BIGINT) AS n
    FROM s GROUP BY ALL
    """,
)
def paired_transits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _next(spark, sf_dir).withColumn("ds", F.to_date("entry_ts"))
    stats = transit.transit_stats(found, ["ds", "from_id", "to_id"])
    return rounded(transit.paired_transits(stats, ["from_id", "to_id"]), "median_h", "mean_h", "p90_h")


@query(
    "transit_baseline",
    f"""
    WITH {NEXT_SQL}, s AS (SELECT CAST(entry_ts AS DATE) AS ds, from_id || '->' || to_id AS corridor_id, median(hours) AS m FROM n GROUP BY ALL)
    SELECT corridor_id, round(median(m), 6) AS baseline_h, count(*) AS days FROM s
    WHERE ds >= DATE '2024-01-25' - 30 AND ds < DATE '2024-01-25' GROUP BY ALL
    """,
)
def transit_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _next(spark, sf_dir).select(F.to_date("entry_ts").alias("ds"), F.concat("from_id", F.lit("->"), "to_id").alias("corridor_id"), "hours")
    daily = transit.transit_stats(found, ["ds", "corridor_id"])
    return rounded(transit.baseline_median(daily, F.lit("2024-01-25").cast("date")), "baseline_h")


@query(
    "lag_transit",
    """
    WITH l AS (SELECT user_id, ts, event_type, lag(event_type) OVER w AS e, lag(ts) OVER w AS t FROM events
               WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    h AS (SELECT CAST(ts AS DATE) AS ds, (epoch(ts) - epoch(t)) / 3600.0 AS h FROM l WHERE event_type = 'purchase' AND e = 'click')
    SELECT ds, round(quantile_cont(h, 0.5), 6) AS p50_h, round(quantile_cont(h, 0.9), 6) AS p90_h, count(*) AS n
    FROM h GROUP BY ds HAVING count(*) >= 3
    """,
)
def lag_transit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(transit.lag_transits(moves(spark, sf_dir), "click", "purchase"), "p50_h", "p90_h")


RANK_SQL = """
    i AS (SELECT user_id AS mmsi, ts AS enter_ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events WHERE event_type = 'signup'),
    o AS (SELECT user_id AS mmsi, ts AS exit_ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events WHERE event_type = 'purchase'),
    p AS (SELECT mmsi, k, enter_ts, exit_ts FROM i JOIN o USING (mmsi, k) WHERE exit_ts > enter_ts)
"""


@query("rank_pairs", f"WITH {RANK_SQL} SELECT mmsi, CAST(k AS INT) AS k, enter_ts, exit_ts FROM p")
def rank_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transit.rank_pairs(moves(spark, sf_dir), "signup", "purchase")


@query(
    "interval_join",
    f"""
    WITH {RANK_SQL} SELECT mmsi, CAST(k AS INT) AS k, count(*) AS n_points, round(avg(value), 6) AS mean_sog
    FROM p JOIN events e ON e.user_id = p.mmsi AND e.ts BETWEEN enter_ts AND exit_ts GROUP BY ALL HAVING count(*) >= 2
    """,
)
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = moves(spark, sf_dir)
    spans = transit.rank_pairs(rows, "signup", "purchase")
    return rounded(transit.interval_join(spans, rows.select("mmsi", "ts", "sog")), "mean_sog")


@query(
    "transit_anomaly",
    """
    WITH l AS (SELECT user_id AS mmsi, ts, event_type AS event, lead(event_type) OVER w AS to_event, lead(ts) OVER w AS to_ts FROM events
               WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    m AS (SELECT *, (epoch(to_ts) - epoch(ts)) / 60.0 AS minutes FROM l),
    f AS (SELECT * FROM m WHERE minutes BETWEEN 0 AND 2400),
    a AS (SELECT *, median(minutes) OVER (PARTITION BY event, to_event) AS med FROM f),
    b AS (SELECT *, CAST(1.4826 AS DOUBLE) * median(abs(minutes - med)) OVER (PARTITION BY event, to_event) AS mad FROM a)
    SELECT mmsi, ts, event, to_event, round(minutes, 4) AS minutes, round(med + 3 * mad, 4) AS "limit" FROM b
    WHERE ts >= TIMESTAMP '2024-01-10' AND minutes > med + 3 * mad
    """,
)
def transit_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = transit.lead_pairs(moves(spark, sf_dir).select("mmsi", "ts", "event"))
    found = transit.transit_anomalies(pairs, ["event", "to_event"], F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'"))
    return rounded(found.select("mmsi", "ts", "event", "to_event", "minutes", "limit"), "minutes", "limit", digits=4)
