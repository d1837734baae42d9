"""Queries whose rules keep state from row to row; their SQL goes from fix to fix by recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.tables import table
from tideline.plans.flow_queries import rounded
from tideline.plans.registry import query
from tideline.streaming import geofence

RULES = geofence.Rules(
    polygons=(
        geofence.Polygon("WEST", ((-0.5, -0.5), (0.0, -0.5), (0.0, 0.5), (-0.5, 0.5)), anchorage=True),
        geofence.Polygon("EAST", ((0.0, -0.5), (0.5, -0.5), (0.5, 0.5), (0.0, 0.5))),
    ),
    gates=(geofence.Gate("MERIDIAN", (0.0, -1.0), (0.0, 1.0)),),
    spoof_kn=5.0,
    ttl_s=6 * 3600,
    anchorage_ttl_s=24 * 3600,
)


FIXES = """
    raw AS (SELECT user_id AS mmsi, epoch(ts) AS t, (event_id * 37 % 100) / 100.0::DOUBLE - 0.5 AS lat, value / 100.0 - 0.5 AS lon, value AS sog, event_id
            FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL)
"""
SAMPLED = f"""
    {FIXES}, one AS (SELECT *, row_number() OVER (PARTITION BY mmsi, floor(t / 60) ORDER BY t, lat, lon, sog) AS r FROM raw WHERE mmsi % 4 <> 0),
    fix AS (SELECT mmsi, t, lat, lon, sog, row_number() OVER v AS n, lag(t) OVER v AS pt, lag(lat) OVER v AS plat, lag(lon) OVER v AS plon
            FROM one WHERE r = 1 WINDOW v AS (PARTITION BY mmsi ORDER BY t, lat, lon, sog))
"""
NM = "2 * 3440.065::DOUBLE * asin(sqrt(least(power(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * power(sin(radians({d} - {c}) / 2), 2), 1)))"
PLACES = """
    poly(place_id, ttl, w, e) AS (VALUES ('WEST', 86400, -0.5::DOUBLE, 0.0::DOUBLE), ('EAST', 21600, 0.0::DOUBLE, 0.5::DOUBLE))
"""
#: Whether the right-open square of a polygon holds the fix.
HOLDS = "({f}.lon >= {p}.w AND {f}.lon < {p}.e AND {f}.lat >= -0.5 AND {f}.lat < 0.5)"


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as fixes on a one-degree square."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("mmsi"), F.col("ts").cast("timestamp").alias("ts"), ((F.col("event_id") * 37 % 100) / 100.0 - 0.5).alias("lat"),
        (F.col("value") / 100.0 - 0.5).alias("lon"), F.col("value").alias("sog"), (F.col("user_id") % 4 != 0).alias("is_tanker"),
    )


@query(
    "geofence_events",
    f"""
    WITH RECURSIVE {SAMPLED}, {PLACES},
    s AS (
        SELECT mmsi, place_id, n, CASE WHEN x THEN 1 ELSE 0 END AS hits, 0 AS misses, false AS ins, CASE WHEN x THEN t END AS seen,
               CAST(NULL AS VARCHAR) AS event, CAST(NULL AS DOUBLE) AS gone, t, lat, lon, sog, plat, plon
        FROM (SELECT *, {HOLDS.format(f="fix", p="poly")} AS x FROM fix, poly WHERE n = 1)
        UNION ALL
        SELECT mmsi, place_id, n, CASE WHEN x THEN hits + 1 ELSE 0 END, CASE WHEN x THEN 0 ELSE misses + 1 END,
               CASE WHEN x THEN ins OR hits + 1 >= 2 ELSE ins AND misses + 1 < 2 END, CASE WHEN x THEN t ELSE seen END,
               CASE WHEN x AND NOT ins AND hits + 1 >= 2 THEN 'enter' WHEN NOT x AND ins AND misses + 1 >= 2 THEN 'exit' END, gone, t, lat, lon, sog, plat, plon
        FROM (
            SELECT f.mmsi, s.place_id, f.n, {HOLDS.format(f="f", p="p")} AS x, f.t, f.lat, f.lon, f.sog, f.plat, f.plon, s.seen,
                   CASE WHEN s.ins AND f.t - s.seen > p.ttl THEN s.seen END AS gone,
                   CASE WHEN s.ins AND f.t - s.seen > p.ttl THEN 0 ELSE s.hits END AS hits, CASE WHEN s.ins AND f.t - s.seen > p.ttl THEN 0 ELSE s.misses END AS misses,
                   s.ins AND f.t - s.seen <= p.ttl AS ins
            FROM s JOIN fix f ON f.mmsi = s.mmsi AND f.n = s.n + 1 JOIN poly p USING (place_id))
    ),
    way AS (SELECT *, CASE WHEN lon <= plon THEN 'AtoB' ELSE 'BtoA' END AS way FROM fix
            WHERE (plon <= 0 AND lon >= 0 OR plon >= 0 AND lon <= 0) AND (lon <> plon OR lat <> plat)),
    turn AS (SELECT *, row_number() OVER (PARTITION BY mmsi, way ORDER BY t) AS i FROM way),
    g AS (
        SELECT mmsi, way, i, t AS told, true AS tell, t, lat, lon, sog FROM turn WHERE i = 1
        UNION ALL
        SELECT w.mmsi, w.way, w.i, CASE WHEN w.t - g.told >= 300 THEN w.t ELSE g.told END, w.t - g.told >= 300, w.t, w.lat, w.lon, w.sog
        FROM g JOIN turn w ON w.mmsi = g.mmsi AND w.way = g.way AND w.i = g.i + 1
    ),
    e AS (
        SELECT mmsi, 'polygon' AS kind, place_id, event, t, lat, lon, sog FROM s WHERE event IS NOT NULL
        UNION ALL SELECT mmsi, 'polygon', place_id, 'exit', gone, plat, plon, NULL FROM s WHERE gone IS NOT NULL
        UNION ALL SELECT mmsi, 'gate', 'MERIDIAN', way, t, lat, lon, sog FROM g WHERE tell
        UNION ALL SELECT mmsi, 'spoof', '', 'jump', t, lat, lon, sog FROM fix WHERE {NM.format(a="plat", b="lat", c="plon", d="lon")} / ((t - pt) / 3600) > 5
    )
    SELECT mmsi, kind, place_id, event, round(t, 3) AS epoch, round(lat, 6) AS lat, round(lon, 6) AS lon, round(sog, 6) AS sog FROM e
    """,
)
def geofence_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes through the state machine."""
    found = geofence.geofence_events(fixes(spark, sf_dir), RULES)
    epoch = F.round(F.unix_micros("ts") / 1e6, 3).alias("epoch")
    return rounded(found.select("mmsi", "kind", "place_id", "event", epoch, "lat", "lon", "sog"), "lat", "lon", "sog")


@query(
    "dwell_sessions",
    f"""
    WITH RECURSIVE {FIXES}, {PLACES}, fix AS (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY t, lat, lon, sog) AS n FROM raw),
    s AS (
        SELECT mmsi, place_id, n, x AS open, t AS entered, t AS last, lat AS llat, lon AS llon, CAST(NULL AS DOUBLE) AS a, CAST(NULL AS DOUBLE) AS b, 0::DOUBLE AS glat, 0::DOUBLE AS glon
        FROM (SELECT *, {HOLDS.format(f="fix", p="poly")} AS x FROM fix, poly WHERE n = 1)
        UNION ALL
        SELECT mmsi, place_id, n, x OR stays, CASE WHEN open THEN entered ELSE t END, CASE WHEN x OR stays THEN t ELSE last END,
               CASE WHEN x OR stays THEN lat ELSE llat END, CASE WHEN x OR stays THEN lon ELSE llon END,
               CASE WHEN open AND NOT x AND NOT stays THEN entered END, CASE WHEN t - last > 3600 THEN last ELSE t END, llat, llon
        FROM (
            SELECT f.mmsi, s.place_id, f.n, {HOLDS.format(f="f", p="p")} AS x, f.t, f.lat, f.lon, s.open, s.entered, s.last, s.llat, s.llon,
                   s.open AND {NM.format(a="s.llat", b="f.lat", c="s.llon", d="f.lon")} <= 25 AND f.sog < 60 AS stays
            FROM s JOIN fix f ON f.mmsi = s.mmsi AND f.n = s.n + 1 JOIN poly p USING (place_id))
    )
    SELECT mmsi, place_id AS polygon_id, round(a, 3) AS epoch_in, round(b, 3) AS epoch_out, CAST(floor((b - a) / 60) AS BIGINT) AS dwell_min, round(glon, 6) AS lon, round(glat, 6) AS lat
    FROM s WHERE a IS NOT NULL AND floor((b - a) / 60) >= 30
    """,
)
def dwell_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed stays of all vessels, with wide limits that the sparse events reach."""
    polygons = tuple(geofence.Polygon(p.polygon_id, p.ring, min_dwell_min=30) for p in RULES.polygons)
    rules = geofence.Rules(polygons=polygons, stay_nm=25.0, stay_kn=60.0, silent_s=3600)
    found = geofence.dwell_sessions(fixes(spark, sf_dir), rules)
    epochs = [F.round(F.unix_micros(f"ts_{x}") / 1e6, 3).alias(f"epoch_{x}") for x in ("in", "out")]
    return rounded(found.select("mmsi", "polygon_id", *epochs, "dwell_min", "lon", "lat"), "lon", "lat")


@query(
    "presence",
    f"""
    WITH RECURSIVE {SAMPLED}, {PLACES},
    s AS (
        SELECT mmsi, place_id, n, x AS started, CAST(x AS INT) AS hits, 0 AS misses, false AS ins, CAST(NULL AS DOUBLE) AS enter, CAST(NULL AS DOUBLE) AS gone, CASE WHEN x THEN t END AS seen,
               CAST(x AS INT) AS cnt, CASE WHEN x THEN sog END AS low, CASE WHEN x THEN sog END AS high, CASE WHEN x THEN sog ELSE 0 END AS total,
               x AS tells, CAST(NULL AS DOUBLE) AS e_enter, CAST(NULL AS DOUBLE) AS e_gone, t AS e_seen, false AS e_ins, 1 AS e_cnt, sog AS e_low, sog AS e_high, sog AS e_total
        FROM (SELECT *, {HOLDS.format(f="fix", p="poly")} AS x FROM fix, poly WHERE n = 1)
        UNION ALL
        SELECT mmsi, place_id, n, started OR x, CASE WHEN x THEN hits + 1 ELSE 0 END, CASE WHEN x OR NOT started THEN 0 ELSE misses + 1 END, CASE WHEN x THEN ins OR enters ELSE ins AND NOT leaves END,
               CASE WHEN enters THEN t WHEN NOT leaves THEN enter END, CASE WHEN leaves THEN t ELSE gone END, CASE WHEN x OR started THEN t END,
               CASE WHEN x THEN cnt + 1 WHEN leaves THEN 0 ELSE cnt END, CASE WHEN x THEN least(low, sog) WHEN NOT leaves THEN low END, CASE WHEN x THEN greatest(high, sog) WHEN NOT leaves THEN high END,
               CASE WHEN x THEN total + sog WHEN leaves THEN 0 ELSE total END,
               x OR leaves OR late, CASE WHEN enters THEN t WHEN x OR leaves THEN enter ELSE p_enter END, CASE WHEN leaves THEN t ELSE gone END, CASE WHEN x OR leaves THEN t ELSE p_seen END, x AND (ins OR enters),
               CASE WHEN x THEN cnt + 1 WHEN leaves THEN cnt ELSE p_cnt END, CASE WHEN x THEN least(low, sog) WHEN leaves THEN low ELSE p_low END,
               CASE WHEN x THEN greatest(high, sog) WHEN leaves THEN high ELSE p_high END, CASE WHEN x THEN total + sog WHEN leaves THEN total ELSE p_total END
        FROM (
            SELECT *, x AND NOT ins AND hits + 1 >= 2 AS enters, NOT x AND ins AND misses + 1 >= 2 AS leaves FROM (
                SELECT mmsi, place_id, n, x, t, sog, started, late, CASE WHEN late THEN 0 ELSE hits END AS hits, CASE WHEN late THEN 0 ELSE misses END AS misses, ins AND NOT late AS ins,
                       CASE WHEN NOT late THEN enter END AS enter, CASE WHEN late THEN seen ELSE gone END AS gone, CASE WHEN late THEN 0 ELSE cnt END AS cnt, CASE WHEN NOT late THEN low END AS low,
                       CASE WHEN NOT late THEN high END AS high, CASE WHEN late THEN 0 ELSE total END AS total, enter AS p_enter, seen AS p_seen, cnt AS p_cnt, low AS p_low, high AS p_high, total AS p_total
                FROM (
                    SELECT s.*, {HOLDS.format(f="f", p="p")} AS x, f.t, f.sog, s.ins AND f.t - s.seen > p.ttl AS late
                    FROM (SELECT mmsi, place_id, n + 1 AS n, started, hits, misses, ins, enter, gone, seen, cnt, low, high, total FROM s) s
                    JOIN fix f ON f.mmsi = s.mmsi AND f.n = s.n JOIN poly p USING (place_id))))
    ), last AS (SELECT *, row_number() OVER (PARTITION BY mmsi, place_id ORDER BY n DESC) AS r FROM s WHERE tells)
    SELECT mmsi, place_id AS polygon_id, round(e_enter, 3) AS enter_epoch, round(e_gone, 3) AS exit_epoch, round(e_seen, 3) AS last_seen_epoch, e_ins AS inside, CAST(e_cnt AS BIGINT) AS samples_inside,
           round(e_low, 6) AS sog_min, round(e_high, 6) AS sog_max, round(e_total / e_cnt, 6) AS sog_avg FROM last WHERE r = 1
    """,
)
def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each vessel was last seen in or leaving a polygon, with its speeds there."""
    found = geofence.presence(fixes(spark, sf_dir), RULES)
    epochs = [F.round(F.unix_micros(f"{c}_ts") / 1e6, 3).alias(f"{c}_epoch") for c in ("enter", "exit", "last_seen")]
    return rounded(found.select("mmsi", "polygon_id", *epochs, "inside", "samples_inside", "sog_min", "sog_max", "sog_avg"), "sog_min", "sog_max", "sog_avg")


@query(
    "stream_tracklets",
    f"""
    WITH RECURSIVE {SAMPLED},
    s AS (
        SELECT mmsi, n, CAST(NULL AS DOUBLE) AS told, CAST(NULL AS DOUBLE) AS start, t FROM fix WHERE n = 1
        UNION ALL
        SELECT mmsi, n, CASE WHEN t - a >= 21600 AND (told IS NULL OR a > told) THEN t ELSE told END, CASE WHEN t - a >= 21600 AND (told IS NULL OR a > told) THEN a END, t
        FROM (SELECT f.mmsi, f.n, s.told, f.t, (SELECT min(x.t) FROM fix x WHERE x.mmsi = f.mmsi AND x.n <= f.n AND f.t - x.t <= 604800) AS a
              FROM s JOIN fix f ON f.mmsi = s.mmsi AND f.n = s.n + 1)
    ), piece AS (SELECT mmsi, start, t FROM s WHERE start IS NOT NULL)
    SELECT p.mmsi, round(p.start, 3) AS epoch_start, round(p.t, 3) AS epoch_end, count(*) AS n_points, round(avg(f.sog), 6) AS mean_sog
    FROM piece p JOIN fix f ON f.mmsi = p.mmsi AND f.t BETWEEN p.start AND p.t GROUP BY ALL
    """,
)
def stream_tracklets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracklets of six hours to a week, for the events are sparse."""
    found = geofence.tracklets(fixes(spark, sf_dir), geofence.Rules(tracklet_s=(6 * 3600, 7 * 86400)))
    epochs = [F.round(F.unix_micros(f"{x}_ts") / 1e6, 3).alias(f"epoch_{x}") for x in ("start", "end")]
    return rounded(found.select("mmsi", *epochs, "n_points", "mean_sog"), "mean_sog")


@query(
    "downsampled_fixes",
    """
    SELECT user_id AS mmsi, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS bucket, min(ts) AS ts, arg_min(value, (ts, event_id)) AS sog FROM events GROUP BY ALL
    """,
)
def downsampled_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fix for each vessel and hour, the first (the batch twin of the stream's rule, for rows in order)."""
    bucket = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("mmsi"), bucket.alias("bucket")).agg(
        F.min("ts").alias("ts"), F.min_by("value", F.struct("ts", "event_id")).alias("sog")
    )
