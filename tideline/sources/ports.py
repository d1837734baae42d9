"""Port, strait, weather and price sources in one form each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.columns import slug

# Words that mark tankers in stays, and berth prefixes of ports.
STAY_WORDS = ("tank", "oil", "product", "chem")
BERTH_PORTS = {"BEANR": "antwerp", "BEZEE": "zeebrugge"}


def port_of(name: Column, berth: Column) -> Column:
    """Slug of the port's name, else the port of the berth's prefix."""
    by_berth = F.coalesce(*[F.when(berth.startswith(p), port) for p, port in BERTH_PORTS.items()])
    return F.coalesce(slug(name), by_berth)


def stay_summary(stays: DataFrame) -> DataFrame:
    """Departures and arrivals of tankers by port and day.

    A stay's actual and expected departures both count; an arrival is the actual one, else the start of the stay.
    ``stays`` is ``ship_type, port_name, berth_in, berth_out, atd, etd, ata, stay_start`` (times as text).
    """
    tankers = stays.where(F.lower("ship_type").rlike("|".join(STAY_WORDS)))
    day = lambda c: F.to_date(F.col(c).try_cast("timestamp")) if isinstance(c, str) else F.to_date(c)
    out_port, in_port = port_of(F.col("port_name"), F.col("berth_out")), port_of(F.col("port_name"), F.col("berth_in"))
    arrival = F.coalesce(F.col("ata").try_cast("timestamp"), F.col("stay_start").try_cast("timestamp"))
    found = F.explode(
        F.array(
            F.struct(out_port.alias("port"), day("atd").alias("d"), F.lit(1).alias("dep"), F.lit(0).alias("arr")),
            F.struct(out_port.alias("port"), day("etd").alias("d"), F.lit(1).alias("dep"), F.lit(0).alias("arr")),
            F.struct(in_port.alias("port"), day(arrival).alias("d"), F.lit(0).alias("dep"), F.lit(1).alias("arr")),
        )
    )
    events = tankers.select(found.alias("e")).select("e.*").where(F.col("port").isNotNull() & F.col("d").isNotNull())
    return events.groupBy(F.col("port").alias("port_code"), F.col("d").alias("ds")).agg(F.sum("dep").alias("departures"), F.sum("arr").alias("arrivals"))


def normalize_calls(rows: DataFrame, ts: tuple[str, ...], event: tuple[str, ...], count: tuple[str, ...], tanker: Column) -> DataFrame:
    """Calls with aliases resolved: time, lower-case event, vessels (1 by default) and tanker flag."""

    def first(names: tuple[str, ...]) -> Column:
        known = [F.col(n) for n in names if n in rows.columns]
        return F.coalesce(*known) if known else F.lit(None).cast("string")

    return rows.select(
        first(ts).try_cast("timestamp").alias("ts"),
        F.lower(F.trim(first(event))).alias("event"),
        F.coalesce(first(count).try_cast("int"), F.lit(1)).alias("vessels"),
        tanker.alias("is_tanker"),
    ).where(F.col("ts").isNotNull() & F.col("event").isNotNull())


def strait_proxy(dwell: DataFrame, region: str, threshold: int = 5, factor: float = 0.45, days: int = 400) -> DataFrame:
    """Closure minutes (ten for each window from ``threshold`` slow vessels on) and wait hours by day, stamped at noon."""
    rows = dwell.where(F.col("region") == region)
    newest = rows.agg(F.max("window_start").alias("_m"))
    kept = rows.join(F.broadcast(newest), F.col("window_start") >= F.col("_m") - F.expr(f"INTERVAL {days} DAYS"))
    return kept.groupBy(F.to_date("window_start").alias("d")).agg(
        F.sum(F.when(F.col("slow_count") >= threshold, 10).otherwise(0)).alias("closure_minutes"),
        F.greatest(F.avg("slow_count") * factor, F.lit(0.0)).alias("wait_hours"),
    ).select((F.col("d").cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS")).alias("ts"), "closure_minutes", "wait_hours")


def weather_flag(wind_kn: Column, gust_kn: Column, wave_m: Column) -> Column:
    """Wind or gust from 25 knots, or waves from 3.5 m; unknown measures don't flag."""
    no = F.lit(False)
    return F.coalesce(wind_kn >= 25, no) | F.coalesce(gust_kn >= 25, no) | F.coalesce(wave_m >= 3.5, no)


def port_moves(rows: DataFrame, ship_type: str | None = None) -> DataFrame:
    """Movements (departures where unknown) by port and day; a ship type, if given, also lets unknown ones pass."""
    if ship_type is not None:
        rows = rows.where(F.col("shiptype").isNull() | (F.lower("shiptype") == ship_type))
    return rows.groupBy("d", "port_code").agg(F.sum(F.coalesce("movements", "departures")).alias("moves"))


def price_series(raw: DataFrame) -> DataFrame:
    """Prices with placeholders for missing values ('' and '.') left out."""
    value = F.when(~F.col("value").isin("", "."), F.col("value")).try_cast("double")
    return raw.select(F.col("ds").try_cast("date").alias("ds"), "series", value.alias("value"), "source").where(
        F.col("ds").isNotNull() & F.col("value").isNotNull()
    )


def pivot_series(rows: DataFrame, names: list[str], d: str = "ds") -> DataFrame:
    """One column for each series, by date."""
    return rows.groupBy(d).pivot("series", names).agg(F.sum("value"))
