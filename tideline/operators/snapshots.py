"""Series views and snapshots: anchored series with totals, the latest of each series, catalogues, clean JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.views import tail_days


def series_with_totals(rows: DataFrame, keys: list[str], d: str, days: int, *names: str) -> DataFrame:
    """Rows of the last ``days`` before the newest, with each key's totals over them.

    A total of daily distinct counts is the sum of the days' counts.
    """
    by = Window.partitionBy(*keys)
    return tail_days(rows, d, days).withColumns({f"{c}_total": F.sum(c).over(by) for c in names})


def filtered(rows: DataFrame, **wanted) -> DataFrame:
    """Rows with the wanted values; a filter that is None lets all pass, a list any of its values, a text with % or _ goes by pattern."""
    for name, value in wanted.items():
        if value is None:
            continue
        if isinstance(value, (list, tuple, set)):
            rows = rows.where(F.col(name).isin(list(value)))
        elif isinstance(value, str) and ("%" in value or "_" in value):
            rows = rows.where(F.col(name).like(value))
        else:
            rows = rows.where(F.col(name) == value)
    return rows


def series_view(rows: DataFrame, d: str, keys: list[str], **wanted) -> DataFrame:
    """Chosen rows with their place from the newest, by key."""
    by = Window.partitionBy(*keys).orderBy(F.desc(d))
    return filtered(rows, **wanted).withColumn("place", F.row_number().over(by))


def latest_of_series(rows: DataFrame, series: str, d: str, x: str, names: list[str]) -> DataFrame:
    """Number of points, and newest date and value, of the named series."""
    return rows.where(F.col(series).isin(names) & F.col(x).isNotNull()).groupBy(series).agg(
        F.count(F.lit(1)).alias("points"), F.max(d).alias(d), F.max_by(x, d).alias(x)
    )


def with_registry(rows: DataFrame, registry: DataFrame, key: str = "mmsi") -> DataFrame:
    """Vessels with what the registry says of them, and whether it knows them."""
    known = registry.withColumn("known", F.lit(True))
    return rows.join(known, key, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def top_nulls_last(rows: DataFrame, x: str, ties: list[str], n: int) -> DataFrame:
    """The ``n`` largest values with their place, those unknown after all others."""
    placed = rows.orderBy(F.desc_nulls_last(x), *ties).limit(n)
    return placed.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last(x), *ties)))


def clean_json(*names: str) -> Column:
    """The columns as one JSON object, in which what is no finite number is null."""
    clean = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c)
    return F.to_json(F.struct(*[clean(c) for c in names]), {"ignoreNullFields": "false"})


def index_snapshot(daily: DataFrame, keys: list[str], d: str = "d", x: str = "x", width: int = 70) -> DataFrame:
    """Each series' newest value, its change on the day before in units and per cent, and its mid-rank in its last ``width`` days."""
    by = Window.partitionBy(*keys).orderBy(F.desc(d))
    last = daily.withColumn("place", F.row_number().over(by)).where(F.col("place") <= width)
    at = lambda n: F.max(F.when(F.col("place") == n, F.col(x)))
    heads = last.groupBy(*keys).agg(F.max(d).alias("newest"), at(1).alias("value"), at(2).alias("before"))
    same = F.abs(F.col(x) - F.col("value")) <= 1e-8 + 1e-5 * F.abs(F.col("value"))
    ranked = last.join(heads, keys).groupBy(*keys, "newest", "value", "before").agg(
        (F.sum(F.when(same, 0.5).when(F.col(x) < F.col("value"), 1.0).otherwise(0.0)) / F.count(F.lit(1)) * 100).alias("rank_pct")
    )
    return ranked.select(
        *keys, "newest", "value", (F.col("value") - F.col("before")).alias("delta"), (F.try_divide(F.col("value") - F.col("before"), "before") * 100).alias("delta_pct"), "rank_pct"
    )


def signals_snapshot(daily: DataFrame, keys: list[str], d: str = "d", x: str = "x") -> DataFrame:
    """``index_snapshot`` with a flag on series in their top tenth."""
    return index_snapshot(daily, keys, d, x).withColumn("top_decile", F.col("rank_pct") >= 90)


def corridor_features(summary: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Corridors of the catalogue (a small dimension: corridor_id, name, gates) with summed flux of their gates, those without flux left out."""
    gates = catalogue.select("corridor_id", "name", F.explode("gates").alias("gate_id"))
    joined = gates.join(summary, "gate_id", "left").groupBy("corridor_id", "name").agg(
        F.sum(F.coalesce("flux", F.lit(0))).alias("flux"), F.coalesce(F.max("z"), F.lit(0.0)).alias("z")
    )
    return joined.where(F.col("flux") > 0)


def extent(rows: DataFrame, by: list[str], margin: float = 2.0) -> DataFrame:
    """Box around the positions of each group, widened by ``margin`` degrees."""
    return rows.groupBy(*by).agg(
        (F.min("lat") - margin).alias("south"), (F.max("lat") + margin).alias("north"), (F.min("lon") - margin).alias("west"), (F.max("lon") + margin).alias("east")
    )
