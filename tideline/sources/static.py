"""Static vessel messages, snapshots of raw payloads, and made-up series for trials."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.registry import latest_row
from tideline.sources.ais import at

# Names of type codes. Codes of the first list have variants, by their last digit, of the second.
FAMILIES = {60: "Passenger", 70: "Cargo", 80: "Tanker", 90: "Other"}
VARIANTS = {0: "", 1: " (Hazardous A)", 2: " (Hazardous B)", 3: " (Hazardous C)", 4: " (Hazardous D)", 9: " (No additional info)"}
SINGLE = {
    20: "WIG", 30: "Fishing", 40: "Towing", 50: "Pilot Vessel", 51: "Search and Rescue", 52: "Tug", 53: "Port Tender", 54: "Anti-pollution",
    55: "Law Enforcement", 58: "Medical Transport", 59: "Non-combatant ship",
}
TYPE_NAMES = SINGLE | {code + digit: name + variant for code, name in FAMILIES.items() for digit, variant in VARIANTS.items()}
# Where each field of a static message may stand, first found wins; paths under the static data, then others.
BODIES = ("$.Message.ShipStaticData", "$.Message.StaticData")
STATIC_FIELDS = {
    "name": ("Name", "ShipName"), "callsign": ("CallSign", "Callsign"), "imo": ("ImoNumber", "IMO"), "destination": ("Destination",), "eta": ("Eta", "ETA"),
    "draught": ("Draught", "MaximumStaticDraught"), "dimension_a": ("DimensionA", "Dimension.A"), "dimension_b": ("DimensionB", "Dimension.B"),
    "dimension_c": ("DimensionC", "Dimension.C"), "dimension_d": ("DimensionD", "Dimension.D"),
}
TYPE_FIELDS = ("Type", "ShipType", "shipType", "ShipTypeCode")
ID_PATHS = ("$.MMSI", "$.MetaData.MMSI", "$.metadata.MMSI", *(f"{b}.{f}" for b in BODIES for f in ("UserID", "MMSI")))


def type_name(code: Column) -> Column:
    """Name of a type code; unknown ones are numbered."""
    names = F.create_map(*[F.lit(x) for pair in TYPE_NAMES.items() for x in pair])
    return F.when(code.isNotNull(), F.coalesce(F.element_at(names, code), F.concat(F.lit("Type "), code.cast("string"))))


def static_messages(messages: DataFrame, payload: str = "payload", rx_time: str = "rx_time") -> DataFrame:
    """Static data of the messages of type 5: one row for each with a usable id (nine digits after padding)."""
    under = lambda names: at("parsed", tuple(f"{b}.{n}" for b in BODIES for n in names))
    codes = [F.try_variant_get("parsed", p, "string").try_cast("int") for n in TYPE_FIELDS for p in (*(f"{b}.{n}" for b in BODIES), f"$.Message.{n}")]
    fields = [
        at("parsed", ("$.Message.MessageType", "$.Message.msgType")).alias("kind"), at("parsed", ID_PATHS).try_cast("long").alias("mmsi"),
        F.coalesce(*codes).alias("code"), at("parsed", (*(f"{b}.ShipTypeName" for b in BODIES), "$.MetaData.ShipType", "$.MetaData.shipType")).alias("type_text"),
        *[under(names).alias(c) for c, names in STATIC_FIELDS.items()],
    ]
    # parsed once, as in ais.canonicalize
    parsed = messages.select(rx_time, F.try_parse_json(payload).alias("parsed"))
    raw = parsed.select(rx_time, F.inline(F.array(F.struct(*fields)))).where((F.col("kind") == "5") & F.col("mmsi").between(0, 999_999_999))
    return raw.select(
        "mmsi", F.col(rx_time).alias("ts"), *[F.trim(c).alias(c) for c in ("name", "callsign", "imo", "destination")], "eta",
        F.col("draught").try_cast("double").alias("draught"), *[F.col(f"dimension_{x}").try_cast("int").alias(f"dimension_{x}") for x in "abcd"],
        F.col("code").alias("shiptype_num"), F.coalesce(type_name(F.col("code")), "type_text").alias("shiptype_str"),
    )


def latest_snapshots(raw: DataFrame, keys: list[str], fetched: str = "fetched_at") -> DataFrame:
    """Of each key's snapshots the newest, with a digest of its payload and the number of snapshots."""
    counted = raw.groupBy(*keys).agg(F.count(F.lit(1)).alias("snapshots"))
    return latest_row(raw, keys, [fetched, "payload"]).join(counted, keys).withColumn("digest", F.md5("payload"))


def made_up_series(spark: SparkSession, names: list[str], start: str, days: int, seed: int = 42) -> DataFrame:
    """``d, series, value``: a yearly wave with a jitter from a hash of series, day and seed; the same wherever it is made."""
    day = spark.range(days).select(F.col("id").cast("int").alias("i"), F.explode(F.array(*map(F.lit, names))).alias("series"))
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "series", F.col("i").cast("string"))), 1, 6), 16, 10).cast("double")
    wave = F.sin(F.col("i") * F.lit(2 * math.pi / 365.25)) * 10
    return day.select(F.date_add(F.lit(start).cast("date"), F.col("i")).alias("d"), "series", (50 + wave + digest / float(1 << 24)).alias("value"))
