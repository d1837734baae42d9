"""Queries on places, the registry and sources. Coordinates come from integer arithmetic on keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.tables import table
from tideline.functions.columns import bearing, haversine, slug
from tideline.operators import clusters, gates, geo, ocean, registry, shapes
from tideline.plans.flow_queries import K, k, moves, rounded
from tideline.plans.registry import query
from tideline.sources import ais, ports

POINTS = "p AS (SELECT o_orderkey AS point_id, o_custkey AS mmsi, o_orderdate AS ts, (o_orderkey * 37 % 1800) / 10.0::DOUBLE - 90 AS lat, (o_orderkey * 53 % 3600) / 10.0::DOUBLE - 180 AS lon FROM orders)"
BOXES = [("alpha", 10.0, -20.0, 40.0, 30.0), ("beta", 20.0, 10.0, 55.0, 60.5), ("gamma", -35.5, -70.0, -5.0, -10.0)]
BOX_VALUES = ", ".join(f"('{n}', {s}::DOUBLE, {w}::DOUBLE, {t}::DOUBLE, {e}::DOUBLE)" for n, s, w, t, e in BOXES)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("point_id"), F.col("o_custkey").alias("mmsi"), F.col("o_orderdate").alias("ts"),
        ((key * 37 % 1800) / 10.0 - 90).alias("lat"), ((key * 53 % 3600) / 10.0 - 180).alias("lon"),
    )


@query(
    "region_tagging",
    f"""
    WITH {POINTS} SELECT point_id, CASE WHEN lat BETWEEN 10 AND 40 AND lon BETWEEN -20 AND 30 THEN 'alpha'
        WHEN lat BETWEEN 20 AND 55 AND lon BETWEEN 10 AND 60.5 THEN 'beta' WHEN lat BETWEEN -35.5 AND -5 AND lon BETWEEN -70 AND -10 THEN 'gamma' END AS region FROM p
    """,
)
def region_tagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("point_id", geo.region_of("lat", "lon", BOXES).alias("region"))


@query(
    "bbox_join",
    f"""
    WITH {POINTS}, b(name, s, w, n, e) AS (VALUES {BOX_VALUES})
    SELECT name, count(*) AS positions, count(DISTINCT mmsi) AS vessels, max(ts) AS last_seen FROM p JOIN b ON lat BETWEEN s AND n AND lon BETWEEN w AND e GROUP BY name
    """,
)
def bbox_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = spark.createDataFrame(BOXES, "name string, south double, west double, north double, east double")
    return geo.box_join(points(spark, sf_dir), boxes).groupBy("name").agg(
        F.count(F.lit(1)).alias("positions"), F.countDistinct("mmsi").alias("vessels"), F.max("ts").alias("last_seen")
    )


@query(
    "point_in_polygon",
    f"""
    WITH {POINTS} SELECT point_id, 'DIAMOND' AS polygon_id FROM p WHERE abs(lat - 0.05) + abs(lon - 0.05) < 40
    UNION ALL SELECT point_id, 'WEDGE' FROM p WHERE lon > -100.05 AND lat > 20.05 AND (lat - 20.05) + (lon + 100.05) < 30
    """,
)
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    rings = spark.createDataFrame(
        [
            ("DIAMOND", [40.05, 0.05, -39.95, 0.05], [0.05, 40.05, 0.05, -39.95]),
            ("WEDGE", [-100.05, -70.05, -100.05], [20.05, 20.05, 50.05]),
        ],
        "polygon_id string, xs array<double>, ys array<double>",
    )
    return geo.polygon_join(points(spark, sf_dir), rings).select("point_id", "polygon_id")


@query(
    "nearest_grid",
    f"""
    WITH {POINTS}, g AS (SELECT i, j, (i * 7 + j) % 23 AS value FROM range(-1, 92) a(i), range(-1, 182) b(j)),
    s AS (SELECT point_id, CAST(floor((lat + 90) / 2.0 + 0.5) AS INT) AS i, CAST(floor((lon + 180) / 2.0 + 0.5) AS INT) AS j FROM p)
    SELECT point_id, s.i, s.j, CAST(value AS BIGINT) AS value FROM s LEFT JOIN g ON g.i = s.i AND g.j = s.j
    """,
)
def nearest_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = spark.range(-1, 92).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(-1), F.lit(181))).alias("j"))
    grid = i.withColumn("value", ((F.col("i") * 7 + F.col("j")) % 23).cast("long"))
    return geo.nearest_cell(points(spark, sf_dir), grid, -90.0, -180.0, 2.0).select("point_id", "i", "j", "value")


@query(
    "knn_join",
    """
    WITH a AS (SELECT s_suppkey AS point_id, (s_suppkey * 7 % 40) / 20.0::DOUBLE AS lat, (s_suppkey * 11 % 40) / 20.0::DOUBLE AS lon, TIMESTAMP '2024-01-10' AS ts FROM supplier),
    c AS (SELECT (p_partkey * 3 % 80) / 40.0::DOUBLE AS clat, (p_partkey * 13 % 80) / 40.0::DOUBLE AS clon, TIMESTAMP '2024-01-10' + to_minutes(CAST(p_partkey % 600 - 300 AS INT)) AS cts, p_retailprice AS value FROM part),
    j AS (SELECT point_id, value, sqrt((lat - clat) ** 2 + (lon - clon) ** 2) AS d, abs(epoch(ts) - epoch(cts)) / 3600.0 AS hours, cts, clat, clon FROM a, c),
    r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY round(d, 9), cts, clat, clon, value) AS r FROM j WHERE d < 0.6),
    k AS (SELECT *, d * 111.0 AS km FROM r WHERE r <= 5 AND d * 111.0 <= 50 AND hours <= 6)
    SELECT point_id, round(arg_min(value, (round(km + 10 * hours, 6), r)), 4) AS value FROM k GROUP BY point_id
    """,
)
def knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, part = F.col("s_suppkey"), F.col("p_partkey")
    at = F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'")
    near = table(spark, sf_dir, "supplier").select(
        key.alias("point_id"), (key * 7 % 40 / 20.0).alias("lat"), (key * 11 % 40 / 20.0).alias("lon"), at.alias("ts")
    )
    cells = table(spark, sf_dir, "part").select(
        (part * 3 % 80 / 40.0).alias("lat"), (part * 13 % 80 / 40.0).alias("lon"),
        (at + F.make_dt_interval(mins=(part % 600 - 300).cast("int"))).alias("ts"), F.col("p_retailprice").alias("value"),
    )
    return rounded(geo.knn_cells(near, cells, most_hours=6.0, width=0.6).select("point_id", "value"), "value", digits=4)


HAVERSINE = "2 * 3440.065::DOUBLE * asin(sqrt(least(power(sin((radians(lat) - radians(a)) / 2), 2) + cos(radians(a)) * cos(radians(lat)) * power(sin((radians(lon) - radians(o)) / 2), 2), 1)))"


@query(
    "teleport",
    f"""
    WITH {POINTS}, l AS (SELECT *, lag(lat) OVER w AS a, lag(lon) OVER w AS o, lag(ts) OVER w AS t FROM (SELECT mmsi, ts, min(lat) AS lat, min(lon) AS lon FROM p GROUP BY ALL)
        WINDOW w AS (PARTITION BY mmsi ORDER BY ts)),
    s AS (SELECT mmsi, ts, {HAVERSINE} / nullif((epoch(ts) - epoch(t)) / 3600.0, 0) AS v FROM l)
    SELECT mmsi, ts, round(v, 5) AS implied_kn FROM s WHERE v > 2
    """,
)
def teleport(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixes = points(spark, sf_dir).groupBy("mmsi", "ts").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    return rounded(geo.implausible(fixes, limit_kn=2.0).select("mmsi", "ts", "implied_kn"), "implied_kn", digits=5)


@query(
    "distance_bearing",
    f"""
    WITH {POINTS}, q AS (SELECT point_id, lat, lon, 1.3::DOUBLE AS a, 103.8::DOUBLE AS o FROM p)
    SELECT point_id, round({HAVERSINE}, 5) AS nm, round(((degrees(atan2(sin(radians(lon) - radians(o)) * cos(radians(lat)),
        cos(radians(a)) * sin(radians(lat)) - sin(radians(a)) * cos(radians(lat)) * cos(radians(lon) - radians(o)))) % 360) + 360) % 360, 4) AS course FROM q
    """,
)
def distance_bearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, o = F.lit(1.3), F.lit(103.8)
    out = points(spark, sf_dir).select("point_id", haversine(a, o, "lat", "lon").alias("nm"), bearing(a, o, "lat", "lon").alias("course"))
    return rounded(rounded(out, "nm", digits=5), "course", digits=4)


@query(
    "track_interpolation",
    """
    WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS track_id, l_quantity AS lat0, l_discount AS lon0, l_tax AS lat1, l_quantity / 2 AS lon1,
                      epoch(o_orderdate) AS a, epoch(l_shipdate) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT track_id, CAST(k AS INT) AS k, round(lat0 + k / 4.0 * (lat1 - lat0), 6) AS lat, round(lon0 + k / 4.0 * (lon1 - lon0), 6) AS lon,
           CAST(floor(a + k / 4.0 * (b - a)) AS BIGINT) AS epoch FROM t, range(5) r(k)
    """,
)
def track_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    tracks = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("track_id"), F.col("l_quantity").alias("lat0"), F.col("l_discount").alias("lon0"),
        F.col("l_tax").alias("lat1"), (F.col("l_quantity") / 2).alias("lon1"), F.col("o_orderdate").alias("start_ts"), F.col("l_shipdate").alias("end_ts"),
    )
    return rounded(geo.interpolate(tracks, 5), "lat", "lon")


@query(
    "latest_fix",
    """
    SELECT user_id AS mmsi, ts, event_type AS region, value AS sog FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1
    """,
)
def latest_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("mmsi"), "ts", "event_id", F.col("event_type").alias("region"), F.col("value").alias("sog"))
    return registry.latest_row(rows, ["mmsi"], ["ts", "event_id"]).drop("event_id")


@query(
    "golden_semi",
    """
    SELECT user_id AS mmsi, ts, event_type AS event FROM events
    WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90) ORDER BY ts DESC, mmsi LIMIT 200
    """,
)
def golden_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = moves(spark, sf_dir)
    chosen = rows.where("event = 'purchase' AND sog > 90").select("mmsi")
    return registry.golden(rows.select("mmsi", "ts", "event"), chosen).orderBy(F.desc("ts"), "mmsi").limit(200)


@query("unknown_anti", "SELECT c_custkey AS mmsi, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_totalprice > 400000 THEN o_custkey ELSE -1 - o_custkey END FROM orders)")
def unknown_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    vessels = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("mmsi"), F.col("c_name").alias("name"))
    known = table(spark, sf_dir, "orders").select(F.when(F.col("o_totalprice") > 400000, F.col("o_custkey")).otherwise(-1 - F.col("o_custkey")).alias("mmsi"))
    return registry.unknown(vessels, known)


@query(
    "static_registry",
    """
    SELECT o_custkey AS mmsi, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_updated, count(*) AS update_count,
           arg_max(o_orderpriority, (o_orderdate, o_orderpriority)) AS name FROM orders GROUP BY o_custkey
    """,
)
def static_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("mmsi"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("name"))
    return registry.static_registry(rows, fields=("name",))


@query(
    "keyed_upsert",
    """
    WITH o AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE -1 - o_custkey END AS k FROM orders),
    d AS (SELECT k, o_totalprice AS v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o_orderkey DESC) AS n FROM o) WHERE n = 1)
    SELECT k, v FROM d UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT k FROM d)
    """,
)
def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    # keys of other states are new to the table
    key = F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).otherwise(-1 - F.col("o_custkey"))
    delta = table(spark, sf_dir, "orders").select(key.alias("k"), F.col("o_totalprice").alias("v"), "o_orderkey")
    newest = registry.latest_row(delta, ["k"], ["o_orderkey"]).drop("o_orderkey")
    return registry.upsert(base, newest, ["k"])


RULES = """
    r AS (SELECT o_custkey AS mmsi, 'h1_terminal' AS s, 0.9::DOUBLE AS c FROM orders GROUP BY 1 HAVING max(o_totalprice) > 400000
          UNION ALL SELECT o_custkey, 'h2_sts', 0.8 FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 2000000
          UNION ALL SELECT o_custkey, 'h3_gates', 0.7 FROM orders GROUP BY 1 HAVING count(*) >= 8)
"""


def _evidence(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, str, float]]:
    sums = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("mmsi")).agg(
        F.max("o_totalprice").alias("m"), F.sum("o_totalprice").alias("s"), F.count(F.lit(1)).alias("n")
    )
    return [(sums.where("m > 400000"), "h1_terminal", 0.9), (sums.where("s > 2000000"), "h2_sts", 0.8), (sums.where("n >= 8"), "h3_gates", 0.7)]


@query(
    "registry_max_confidence",
    f"WITH {RULES} SELECT mmsi, arg_max(s, c) AS type_source, max(c) AS confidence, count(*) AS rules FROM r GROUP BY mmsi",
)
def registry_max_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.heuristic_confidence(_evidence(spark, sf_dir))


@query(
    "registry_merge",
    f"""
    WITH {RULES}, p AS (SELECT mmsi, arg_max(s, c) AS s, max(c) AS c FROM r GROUP BY mmsi),
    g AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE -c_custkey END AS mmsi, 'static' AS s, CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 10) / 10.0::DOUBLE END AS c FROM customer)
    SELECT coalesce(g.mmsi, p.mmsi) AS mmsi, CASE WHEN p.c IS NOT NULL AND (g.c IS NULL OR p.c > g.c) THEN p.s ELSE g.s END AS type_source,
           CASE WHEN p.c IS NOT NULL AND (g.c IS NULL OR p.c > g.c) THEN p.c ELSE g.c END AS confidence FROM g FULL JOIN p ON p.mmsi = g.mmsi
    """,
)
def registry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    held = table(spark, sf_dir, "customer").select(
        F.when(key % 3 == 0, key).otherwise(-key).alias("mmsi"), F.lit("static").alias("type_source"), F.when(key % 4 != 0, key % 10 / 10.0).alias("confidence")
    )
    return registry.merge_confidence(held, registry.heuristic_confidence(_evidence(spark, sf_dir)))


@query(
    "confidence_decay",
    """
    WITH l AS (SELECT o_custkey AS mmsi, CAST(max(o_orderdate) AS DATE) AS last_seen, (o_custkey % 10) / 10.0::DOUBLE AS c FROM orders GROUP BY o_custkey)
    SELECT mmsi, last_seen, round(CASE WHEN date_diff('day', last_seen, DATE '2001-12-31') > 180 THEN least(c, greatest(c - 0.2, 0.5)) ELSE c END, 6) AS confidence FROM l
    """,
)
def confidence_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("mmsi")).agg(F.to_date(F.max("o_orderdate")).alias("last_seen"))
    held = last.withColumn("confidence", F.col("mmsi") % 10 / 10.0)
    return rounded(registry.decay(held, F.lit("2001-12-31").cast("date")), "confidence")


@query(
    "registry_backfill",
    """
    SELECT o_orderkey, o_custkey AS mmsi, CASE WHEN c_custkey IS NOT NULL THEN c_nationkey + 70 BETWEEN 80 AND 89 END AS is_tanker
    FROM orders LEFT JOIN (SELECT CASE WHEN c_acctbal > 0 THEN c_custkey ELSE -1 - c_custkey END AS c_custkey, c_nationkey FROM customer) ON c_custkey = o_custkey
    """,
)
def registry_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("mmsi"), F.lit(False).alias("is_tanker"))
    # vessels that no fix belongs to stand for some of those that the registry lacks
    vessel = F.when(F.col("c_acctbal") > 0, F.col("c_custkey")).otherwise(-1 - F.col("c_custkey"))
    held = table(spark, sf_dir, "customer").select(vessel.alias("mmsi"), (F.col("c_nationkey") + 70).alias("ship_type_code"))
    return registry.backfill(rows, held)


@query(
    "registry_summary",
    """
    SELECT c_mktsegment AS type_source, count(*) AS vessels, CAST(sum(CASE WHEN c_nationkey >= 10 THEN 1 ELSE 0 END) AS BIGINT) AS tankers, round(avg(c_acctbal), 6) AS avg_confidence
    FROM customer GROUP BY 1
    """,
)
def registry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("type_source"), (F.col("c_nationkey") >= 10).alias("is_tanker"), F.col("c_acctbal").alias("confidence")
    )
    return rounded(registry.summary(held), "avg_confidence")


@query(
    "corridor_keepmax",
    """
    WITH f AS (SELECT event_type AS corridor_id, CAST(ts AS DATE) AS ds, count(*) AS flux FROM events GROUP BY ALL)
    SELECT corridor_id, flux, ds FROM (SELECT *, row_number() OVER (PARTITION BY corridor_id ORDER BY flux DESC, ds DESC) AS n FROM f) WHERE n = 1
    """,
)
def corridor_keepmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = moves(spark, sf_dir).groupBy(F.col("event").alias("corridor_id"), F.to_date("ts").alias("ds")).agg(F.count(F.lit(1)).alias("flux"))
    return registry.keep_max(features, "corridor_id", "flux")


@query(
    "data_status",
    """
    SELECT 'events' AS "table", count(*) AS rows, max(ts) AS latest FROM events
    UNION ALL SELECT 'lineitem', count(*), max(l_shipdate) FROM lineitem UNION ALL SELECT 'orders', count(*), max(o_orderdate) FROM orders
    """,
)
def data_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate"}
    return registry.data_status({name: (table(spark, sf_dir, name), ts) for name, ts in named.items()})


@query(
    "json_canonical",
    f"""
    WITH m AS (SELECT event_id, user_id, ts, value, {K} AS k, event_type FROM events),
    f AS (SELECT *, k % 200 - 95.0 AS lat, (k * 3) % 400 - 190.0 AS lon, value / 2 AS sog, value * 4 AS cog FROM m)
    SELECT user_id + 100000000 AS mmsi, ts AS msg_time, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, round(sog, 6) AS sog,
           round(CASE WHEN cog BETWEEN 0 AND 360 THEN cog END, 6) AS cog, CASE WHEN event_type <> 'view' THEN CAST(k % 30 + 70 AS INT) END AS shiptype_num,
           CASE WHEN event_type = 'view' THEN true ELSE k % 30 + 70 BETWEEN 80 AND 89 END AS is_tanker
    FROM f WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND sog BETWEEN 0 AND 40
    """,
)
def json_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = F.struct(
        (k() % 200 - 95.0).alias("Latitude"), ((k() * 3) % 400 - 190.0).alias("Longitude"), (F.col("value") / 2).alias("Sog"), (F.col("value") * 4).alias("Cog"),
        F.when(F.col("event_type") == "view", F.lit("Crude Tanker")).otherwise((k() % 30 + 70).cast("string")).alias("ShipType"),
    )
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("decimal(20,6)")
    payload = F.to_json(
        F.struct((F.col("user_id") + 100000000).alias("MMSI"), F.struct(seconds.alias("receivedTimestamp")).alias("MetaData"), F.struct(report.alias("PositionReport")).alias("Message"))
    )
    messages = table(spark, sf_dir, "events").select(payload.alias("payload"), F.lit("2024-02-01").cast("timestamp").alias("rx_time"))
    out = ais.canonicalize(messages).select("mmsi", F.col("msg_time").cast("timestamp_ntz").alias("msg_time"), "lat", "lon", "sog", "cog", "shiptype_num", "is_tanker")
    return rounded(out, "sog", "cog")


@query(
    "portstay_summary",
    """
    WITH s AS (SELECT c_mktsegment AS t, n_name AS p, o_orderdate AS a, l_shipdate AS b, l_linenumber AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
               JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
    e AS (SELECT p, CAST(b AS DATE) AS d, 1 AS dep, 0 AS arr FROM s UNION ALL SELECT p, CAST(b AS DATE), 1, 0 FROM s WHERE n % 2 = 0 UNION ALL SELECT p, CAST(a AS DATE), 0, 1 FROM s)
    SELECT regexp_replace(regexp_replace(lower(trim(p)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS port_code, d AS ds, CAST(sum(dep) AS BIGINT) AS departures, CAST(sum(arr) AS BIGINT) AS arrivals FROM e GROUP BY ALL
    """,
)
def portstay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    rows = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(
        F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")
    )
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "Crude Oil").when(F.col("c_mktsegment") == "MACHINERY", "Chem carrier").otherwise("Bulk")
    text = lambda c: F.col(c).cast("string")
    stays = rows.select(
        kind.alias("ship_type"), F.col("n_name").alias("port_name"), F.lit(None).cast("string").alias("berth_in"), F.lit(None).cast("string").alias("berth_out"),
        text("l_shipdate").alias("atd"), F.when(F.col("l_linenumber") % 2 == 0, text("l_shipdate")).alias("etd"),
        F.when(F.col("l_linenumber") % 3 == 0, text("o_orderdate")).alias("ata"), text("o_orderdate").alias("stay_start"),
    )
    return ports.stay_summary(stays)


@query(
    "strait_proxy",
    """
    WITH d AS (SELECT time_bucket(INTERVAL '10 minutes', ts) AS w, count(DISTINCT CASE WHEN value < 80 THEN user_id END) AS n FROM events WHERE event_type = 'view' GROUP BY 1)
    SELECT CAST(CAST(w AS DATE) AS TIMESTAMP) + INTERVAL 12 HOURS AS ts, CAST(sum(CASE WHEN n >= 3 THEN 10 ELSE 0 END) AS BIGINT) AS closure_minutes, round(greatest(avg(n) * 0.45, 0), 6) AS wait_hours
    FROM d WHERE w >= (SELECT max(w) FROM d) - INTERVAL 400 DAYS GROUP BY CAST(w AS DATE)
    """,
)
def strait_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.operators.dwell import dwell_windows
    from tideline.plans.flow_queries import fixes

    return rounded(ports.strait_proxy(dwell_windows(fixes(spark, sf_dir), F.col("sog") < 80), "view", threshold=3), "wait_hours")


@query(
    "weather_flags",
    """
    SELECT l_orderkey, l_linenumber, coalesce(l_quantity >= 25, false) OR coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 2 END >= 25, false) OR coalesce(l_tax * 50 >= 3.5, false) AS flag FROM lineitem
    """,
)
def weather_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    gust = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity") * 2)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ports.weather_flag(F.col("l_quantity"), gust, F.col("l_tax") * 50).alias("flag"))


@query(
    "port_moves_daily",
    """
    SELECT CAST(o_orderdate AS DATE) AS d, n_name AS port_code, CAST(sum(coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 7 END, o_orderkey % 5)) AS BIGINT) AS moves
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment IN ('BUILDING', 'FURNITURE') GROUP BY ALL
    """,
)
def port_moves_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers, nations = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    key, segment = F.col("o_orderkey"), F.col("c_mktsegment")
    kind = F.when(segment == "BUILDING", "Tanker").when(segment == "FURNITURE", F.lit(None)).otherwise("Bulk")
    moves_rows = rows.select(
        F.to_date("o_orderdate").alias("d"), F.col("n_name").alias("port_code"), kind.alias("shiptype"),
        F.when(key % 2 == 0, key % 7).alias("movements"), (key % 5).alias("departures"),
    )
    return ports.port_moves(moves_rows, "tanker")


@query(
    "slug_names",
    "SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name || ' / ' || p_type)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part",
)
def slug_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", slug(F.concat("p_name", F.lit(" / "), "p_type")).alias("slug"))


@query(
    "price_pivot",
    """
    SELECT CAST(o_orderdate AS DATE) AS ds, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS brent, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS wti,
           round(sum(CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN o_totalprice END), 2) AS dubai
    FROM orders WHERE o_orderkey % 5 > 1 GROUP BY 1
    """,
)
def price_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    raw = table(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").cast("string").alias("ds"), F.when(F.col("o_orderstatus") == "F", "brent").when(F.col("o_orderstatus") == "O", "wti").otherwise("dubai").alias("series"),
        F.when(key % 5 == 0, ".").when(key % 5 == 1, "").otherwise(F.col("o_totalprice").cast("string")).alias("value"), F.lit("mock").alias("source"),
    )
    return rounded(ports.pivot_series(ports.price_series(raw), ["brent", "wti", "dubai"]), "brent", "wti", "dubai", digits=2)


def moored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as dwell points about a place for each nation, some of them at the date line, one in ten far out."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    reach = F.when(key % 10 == 0, 60000.0).otherwise(1500.0) / 111195.0
    lat0, lon0 = nation * 6 - 75.0, F.when(nation % 5 == 0, 179.999).otherwise(nation * 13 - 170.0)
    lon = lon0 + ((key * 6101 % 1013) / 1013.0 - 0.5) * reach / F.cos(F.radians(lat0))
    return table(spark, sf_dir, "customer").select(
        key.alias("point_id"), (lat0 + ((key * 7919 % 1009) / 1009.0 - 0.5) * reach).alias("lat"), F.when(lon > 180, lon - 360).otherwise(lon).alias("lon")
    )


MOORED = """
    c AS (SELECT c_custkey AS id, c_nationkey * 6 - 75.0::DOUBLE AS lat0, CASE WHEN c_nationkey % 5 = 0 THEN 179.999::DOUBLE ELSE c_nationkey * 13 - 170.0::DOUBLE END AS lon0,
                 CASE WHEN c_custkey % 10 = 0 THEN 60000.0::DOUBLE ELSE 1500.0::DOUBLE END / 111195.0::DOUBLE AS reach FROM customer),
    o AS (SELECT id, lat0 + ((id * 7919 % 1009) / 1009.0::DOUBLE - 0.5) * reach AS lat, lon0 + ((id * 6101 % 1013) / 1013.0::DOUBLE - 0.5) * reach / cos(radians(lat0)) AS lon FROM c),
    p AS (SELECT id, lat, CASE WHEN lon > 180 THEN lon - 360 ELSE lon END AS lon FROM o)
"""


@query(
    "anchorage_clusters",
    f"""
    WITH RECURSIVE {MOORED}, near AS (
        SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON abs(a.lat - b.lat) < 0.01
        WHERE 2 * 6371008.8 * asin(sqrt(least(1, power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)))) <= 350
    ), core AS (SELECT a FROM near GROUP BY a HAVING count(*) >= 8),
    l AS (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)),
    r AS (SELECT a, a AS b FROM core UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    k AS (SELECT a AS point_id, min(b) AS cluster_id FROM r GROUP BY a)
    SELECT point_id, cluster_id, true AS core FROM k
    UNION ALL
    SELECT n.a, min(k.cluster_id), false FROM near n JOIN k ON k.point_id = n.b WHERE n.a NOT IN (FROM core) GROUP BY n.a
    """,
)
def anchorage_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.density_clusters(moored(spark, sf_dir), least=8)


#: Regions with their course: one across the date line by its edges, one that only its margin takes across, one by the pole, one in the open.
SEAS = [("fiji", -25.0, 170.0, -10.0, -175.0, 40.0), ("chukchi", 65.0, 165.0, 72.0, 179.5, 90.0), ("north", 86.0, -20.0, 89.5, 20.0, 0.0), ("gulf", 20.0, 45.0, 32.0, 60.0, 300.0)]
SEA_FEATURES = [
    ocean.Feature("wave", "scalar", ("missing", "hs"), ("mean", "p90", "p95")), ocean.Feature("current", "vector", ("u", "v"), ("mean", "p90")), ocean.Feature("against", "opposing", ("u", "v"), ("mean",)),
]
SEA_VALUES = ", ".join(f"('{n}', {', '.join(f'{v}::DOUBLE' for v in values)})" for n, *values in SEAS)
OCEAN = f"""
    g AS (SELECT date_trunc('quarter', l_shipdate) AS ts, (l_orderkey * 37 % 1800) / 10.0::DOUBLE - 90 AS lat, (l_partkey * 53 % 3600) / 10.0::DOUBLE AS lon360, l_quantity AS hs, l_discount - 0.05 AS u, l_tax - 0.04 AS v FROM lineitem),
    w AS (SELECT *, CASE WHEN lon360 >= 180 THEN lon360 - 360 ELSE lon360 END AS lon FROM g),
    b AS (SELECT name, s - 100 / 111.0::DOUBLE AS s, least(90, n + 100 / 111.0::DOUBLE) AS n, w - 100 / 111.0::DOUBLE / greatest(cos(radians((s + n) / 2)), 0.1) AS w,
                 CASE WHEN e < w THEN e + 360 ELSE e END + 100 / 111.0::DOUBLE / greatest(cos(radians((s + n) / 2)), 0.1) AS e, bearing FROM (VALUES {SEA_VALUES}) t(name, s, w, n, e, bearing)),
    h AS (SELECT b.name, w.ts, hs, sqrt(u * u + v * v) AS speed, -(u * cos(radians(bearing)) + v * sin(radians(bearing))) AS against
          FROM w JOIN b ON lat BETWEEN s AND n AND (lon BETWEEN b.w AND b.e OR lon + 360 BETWEEN b.w AND b.e OR lon - 360 BETWEEN b.w AND b.e))
"""
SEA_STATS = """round(avg(hs), 6) AS wave_mean, round(quantile_cont(hs, 0.9), 6) AS wave_p90, round(quantile_cont(hs, 0.95), 6) AS wave_p95,
    round(avg(speed), 6) AS current_mean, round(quantile_cont(speed, 0.9), 6) AS current_p90, round(avg(against), 6) + 0.0::DOUBLE AS against_mean"""


def ocean_grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Line items as cells of a grid counted 0 to 360, and the regions."""
    grid = table(spark, sf_dir, "lineitem").select(
        F.date_trunc("quarter", "l_shipdate").alias("ts"), ((F.col("l_orderkey") * 37 % 1800) / 10.0 - 90).alias("lat"), ((F.col("l_partkey") * 53 % 3600) / 10.0).alias("lon"),
        F.lit(None).cast("double").alias("missing"), F.col("l_quantity").alias("hs"), (F.col("l_discount") - 0.05).alias("u"), (F.col("l_tax") - 0.04).alias("v"),
    )
    return grid, spark.createDataFrame(SEAS, "name string, south double, west double, north double, east double, bearing_deg double")


@query("ocean_features", f"WITH {OCEAN} SELECT name, ts, {SEA_STATS} FROM h GROUP BY name, ts")
def ocean_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, seas = ocean_grid(spark, sf_dir)
    out = ocean.region_features(grid, seas, SEA_FEATURES, km=100.0)
    out = rounded(out.withColumn("ts", F.col("ts").cast("timestamp_ntz")), *[c for c in out.columns if c not in ("name", "ts")])
    # no negative zero
    return out.withColumn("against_mean", F.col("against_mean") + 0.0)


@query("region_metrics", f"WITH {OCEAN} SELECT name, {SEA_STATS}, count(*) AS cells, count(DISTINCT ts) AS times, max(ts) AS newest FROM h GROUP BY name")
def region_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, seas = ocean_grid(spark, sf_dir)
    out = ocean.region_metrics(grid, seas, SEA_FEATURES, km=100.0)
    return rounded(out.withColumn("newest", F.col("newest").cast("timestamp_ntz")), *[c for c in out.columns if c.rpartition("_")[2] in ("mean", "p90", "p95")])


@query("anchorage_outlines")
def anchorage_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outline of each anchorage that doesn't lie across the date line: corners, area and bounds; hulls have no counterpart in the SQL at hand."""
    places = moored(spark, sf_dir)
    held = clusters.density_clusters(places, least=8).join(places, "point_id")
    rings = shapes.outlines(held.withColumn("anchorage", F.col("cluster_id").cast("string")), "anchorage")
    bounds = [F.round(f(c), 6).alias(n) for n, f, c in (("south", F.array_min, "ys"), ("west", F.array_min, "xs"), ("north", F.array_max, "ys"), ("east", F.array_max, "xs"))]
    return rings.where(F.array_max("xs") - F.array_min("xs") < 180).select("anchorage", F.size("xs").alias("corners"), F.round("area_m2", 1).alias("area_m2"), *bounds)


@query("approach_gates")
def approach_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates at 0 to 20 miles across an axis for each nation, whose vertices its customers are; geodesics have no counterpart in the SQL at hand."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    axes = table(spark, sf_dir, "customer").select(
        nation.cast("string").alias("axis_id"), key.alias("seq"), (nation * 13 - 150 + key * 0.0004).alias("lon"), (nation * 5 - 60 + key * 0.0003).alias("lat")
    )
    entries = axes.groupBy("axis_id").agg(F.min("lon").alias("lon"), F.min("lat").alias("lat"))
    found = gates.approach_gates(axes, entries, [0, 2, 5, 10, 20], {10: 1.5, 20: 2.0})
    return rounded(found, "lon", "lat", "azimuth", "left_lon", "left_lat", "right_lon", "right_lat")
