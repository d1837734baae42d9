"""Vessel registry: static data, latest rows, heuristics and backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_row(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; later names break ties."""
    by = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``base`` with the rows of ``delta`` in place of those with equal keys; of equal keys in ``delta`` the last by ``order``."""
    if order:
        delta = latest_row(delta, keys, [order])
    return base.join(delta.select(*keys).distinct(), keys, "left_anti").unionByName(delta, allowMissingColumns=True)


def static_registry(messages: DataFrame, key: str = "mmsi", ts: str = "ts", fields: tuple[str, ...] = ("name", "ship_type")) -> DataFrame:
    """One row for each vessel: first and last time seen, number of updates, and the last fields."""
    last = F.max_by(F.struct(*fields), F.struct(ts, *fields))
    return messages.groupBy(key).agg(
        F.min(ts).alias("first_seen"), F.max(ts).alias("last_updated"), F.count(F.lit(1)).alias("update_count"), last.alias("_l")
    ).select(key, "first_seen", "last_updated", "update_count", *[F.col(f"_l.{f}").alias(f) for f in fields])


def golden(rows: DataFrame, chosen: DataFrame, key: str = "mmsi") -> DataFrame:
    """Rows of the chosen vessels."""
    return rows.join(chosen.select(key), key, "left_semi")


def unknown(vessels: DataFrame, known: DataFrame, key: str = "mmsi") -> DataFrame:
    """Vessels the registry doesn't hold."""
    return vessels.join(known.select(key), key, "left_anti")


def heuristic_confidence(evidence: list[tuple[DataFrame, str, float]]) -> DataFrame:
    """Union of rules (vessels, source, confidence): each vessel's highest confidence and its rule, the first by name of equals."""
    rows = None
    for vessels, source, confidence in evidence:
        one = vessels.select("mmsi").distinct().select("mmsi", F.lit(source).alias("type_source"), F.lit(confidence).alias("confidence"))
        rows = one if rows is None else rows.unionByName(one)
    best = F.max_by(F.struct("type_source", "confidence"), F.struct("confidence", (-F.ascii("type_source")).alias("_t")))
    return rows.groupBy("mmsi").agg(best.alias("b"), F.count(F.lit(1)).alias("rules")).select("mmsi", "b.type_source", "b.confidence", "rules")


def merge_confidence(registry: DataFrame, proposed: DataFrame) -> DataFrame:
    """The registry with proposals that exceed what it holds, or where it holds nothing."""
    new = proposed.select("mmsi", F.col("type_source").alias("_s"), F.col("confidence").alias("_c"))
    better = F.col("_c").isNotNull() & (F.col("confidence").isNull() | (F.col("_c") > F.col("confidence")))
    joined = registry.join(new, "mmsi", "full_outer")
    return joined.select(
        "mmsi", F.when(better, F.col("_s")).otherwise(F.col("type_source")).alias("type_source"),
        F.when(better, F.col("_c")).otherwise(F.col("confidence")).alias("confidence"),
    )


def decay(registry: DataFrame, as_of: Column, days: int = 180, step: float = 0.2, floor: float = 0.5) -> DataFrame:
    """Confidence of vessels not seen for ``days``, less ``step`` but not below ``floor`` (nor raised to it)."""
    stale = F.datediff(as_of, "last_seen") > days
    lower = F.least(F.col("confidence"), F.greatest(F.col("confidence") - step, F.lit(floor)))
    return registry.withColumn("confidence", F.when(stale & F.col("confidence").isNotNull(), lower).otherwise(F.col("confidence")))


def backfill(rows: DataFrame, registry: DataFrame, types: tuple[int, int] = (80, 89)) -> DataFrame:
    """``is_tanker`` from the registry's type code; null where the vessel isn't registered."""
    known = registry.select("mmsi", F.col("ship_type_code").between(*types).alias("is_tanker"))
    return rows.drop("is_tanker").join(known, "mmsi", "left")


def summary(registry: DataFrame) -> DataFrame:
    """Vessels, tankers and mean confidence by source."""
    return registry.groupBy("type_source").agg(
        F.count(F.lit(1)).alias("vessels"), F.sum(F.when(F.col("is_tanker"), 1).otherwise(0)).alias("tankers"), F.avg("confidence").alias("avg_confidence")
    )


def keep_max(features: DataFrame, key: str, x: str) -> DataFrame:
    """Of features with one id the one with the largest ``x``, other columns deciding ties."""
    rest = [c for c in features.columns if c not in (key, x)]
    return features.groupBy(key).agg(F.max(F.struct(x, *rest)).alias("b")).select(key, *[F.col(f"b.{c}").alias(c) for c in (x, *rest)])


def data_status(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Row count and latest time of each table."""
    out = None
    for name, (df, ts) in sorted(tables.items()):
        one = df.agg(F.count(F.lit(1)).alias("rows"), F.max(F.col(ts).cast("timestamp_ntz")).alias("latest")).select(F.lit(name).alias("table"), "rows", "latest")
        out = one if out is None else out.unionByName(one)
    return out
