"""Normalisation of AIS messages: alias paths, plausibility, time inference, tanker flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tanker type codes and words of type names.
TANKER_CODES = (80, 89)
TANKER_WORDS = ("tanker", "crude", "product", "oil", "chem", "lng", "lpg")
#: Where each field may stand in a message, first found wins.
PATHS = {
    "mmsi": ("$.MMSI", "$.mmsi", "$.MetaData.MMSI", "$.Message.PositionReport.UserID"),
    "lat": ("$.Message.PositionReport.Latitude", "$.lat", "$.MetaData.latitude"),
    "lon": ("$.Message.PositionReport.Longitude", "$.lon", "$.MetaData.longitude"),
    "sog": ("$.Message.PositionReport.Sog", "$.sog"),
    "cog": ("$.Message.PositionReport.Cog", "$.cog"),
    "ship_type": ("$.Message.PositionReport.ShipType", "$.shiptype", "$.MetaData.shipType", "$.MetaData.ShipType"),
}
TIME_PATHS = ("$.MetaData.receivedTimestamp", "$.MetaData.time_utc", "$.timestamp", "$.Message.PositionReport.Timestamp")


def at(parsed: Column | str, paths: tuple[str, ...]) -> Column:
    """Text of the first of ``paths`` that a parsed message has."""
    return F.coalesce(*[F.try_variant_get(parsed, p, "string") for p in paths])


def message_time(candidate: Column, rx_time: Column) -> Column:
    """Time of a candidate text: milliseconds, seconds, second of the current minute, or a date text; null if none."""
    v = candidate.try_cast("double")
    return (
        F.when(v > 1e12, F.timestamp_micros((v * 1000).cast("long")))
        .when(v > 1e9, F.timestamp_micros((v * 1_000_000).cast("long")))
        .when(v.between(0, 59), F.date_trunc("minute", rx_time) + F.make_dt_interval(secs=v.cast("decimal(18,6)")))
        .when(v.isNull(), candidate.try_cast("timestamp"))
    )


def infer_time(candidates: Column, rx_time: Column) -> Column:
    """The first usable of the candidate texts, else the time of receipt."""
    return F.coalesce(*[message_time(F.get(candidates, F.lit(i)), rx_time) for i in range(len(TIME_PATHS))], rx_time)


def is_tanker(code: Column, name: Column) -> Column:
    return F.coalesce(code.between(*TANKER_CODES), F.lit(False)) | F.coalesce(F.lower(name).rlike("|".join(TANKER_WORDS)), F.lit(False))


def canonicalize(messages: DataFrame, payload: str = "payload", rx_time: str = "rx_time") -> DataFrame:
    """Position messages in one form; implausible ones go.

    Ids are nine digits after padding, latitude and longitude in range, speed 0 to 40; a course outside 0 to 360 is null.
    """
    fields = [at("parsed", p).alias(c) for c, p in PATHS.items()]
    times = F.array(*[F.try_variant_get("parsed", p, "string") for p in TIME_PATHS]).alias("times")
    # a message is parsed once; its fields are one generated row, below which filters on them can't be pushed
    parsed = messages.select(rx_time, F.try_parse_json(payload).alias("parsed"))
    raw = parsed.select(rx_time, F.inline(F.array(F.struct(*fields, times))))
    typed = raw.select(
        infer_time(F.col("times"), F.col(rx_time)).alias("msg_time"), rx_time, F.lpad("mmsi", 9, "0").alias("mmsi_text"), F.col("mmsi").try_cast("long").alias("mmsi"),
        *[F.col(c).try_cast("double").alias(c) for c in ("lat", "lon", "sog", "cog")],
        F.col("ship_type").try_cast("int").alias("shiptype_num"), F.col("ship_type").alias("shiptype_str"),
    )
    plausible = (
        (F.length("mmsi_text") == 9) & F.col("mmsi").isNotNull() & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
        & (F.col("sog").isNull() | F.col("sog").between(0, 40))
    )
    return typed.where(plausible).withColumn("cog", F.when(F.col("cog").between(0, 360), F.col("cog"))).withColumn(
        "is_tanker", is_tanker(F.col("shiptype_num"), F.col("shiptype_str"))
    ).drop("mmsi_text")


def enrich(fixes: DataFrame, static: DataFrame) -> DataFrame:
    """Fixes without a type take the registry's; works with a static side beside a stream."""
    known = static.select("mmsi", F.col("ship_type").try_cast("int").alias("_t"))
    joined = fixes.join(known, "mmsi", "left").withColumn("shiptype_num", F.coalesce("shiptype_num", "_t")).drop("_t")
    return joined.withColumn("is_tanker", is_tanker(F.col("shiptype_num"), F.col("shiptype_str")))


def ingest_health(fixes: DataFrame, as_of: Column, minutes: int = 5) -> DataFrame:
    """Messages, distinct vessels and tanker share of the last minutes."""
    recent = fixes.where((F.col("rx_time") >= as_of - F.expr(f"INTERVAL {minutes} MINUTES")) & (F.col("rx_time") <= as_of))
    return recent.agg(
        F.count(F.lit(1)).alias("messages"), F.countDistinct("mmsi").alias("vessels"), F.avg(F.col("is_tanker").cast("int")).alias("tanker_share")
    )
