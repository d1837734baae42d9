"""Ocean grids by region: boxes widened by kilometres, grids counted 0 to 360 or across the date line, features by time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.columns import along, nan_to_null
from tideline.operators.geo import KM_PER_DEGREE, box_join

#: The shares that ``p90`` and ``p95`` stand for.
SHARES = {"p90": 0.9, "p95": 0.95}


@dataclass(frozen=True)
class Feature:
    """A ``kind`` (scalar, vector or opposing) over one or two variables of the grid, told by ``stats`` (mean, p90, p95)."""

    name: str
    kind: str
    variables: tuple[str, ...]
    stats: tuple[str, ...] = ("mean",)

    def value(self, bearing_deg: Column) -> Column:
        parts = [nan_to_null(v) for v in self.variables]
        if self.kind == "scalar":
            # the first variable that has a value
            return F.coalesce(*parts)
        if len(parts) < 2 or self.kind not in ("vector", "opposing"):
            raise ValueError(f"feature {self.name}: kind {self.kind} over {len(parts)} variables")
        u, v = parts[:2]
        return F.hypot(u, v) if self.kind == "vector" else along(u, v, F.radians(bearing_deg))


def widened(boxes: DataFrame, km: float) -> DataFrame:
    """``boxes`` (name, south, west, north, east) with ``km`` more on every side, each in one or two parts within -180 to 180 degrees.

    Longitudes widen by the cosine of the middle latitude, 0.1 at least. A box whose east lies west of its west, or that
    reaches beyond 180 degrees, goes on at the other end.
    """
    middle = F.greatest(F.cos(F.radians((F.col("south") + F.col("north")) / 2)), F.lit(0.1))
    more, wide = km / KM_PER_DEGREE, F.lit(km / KM_PER_DEGREE) / middle
    west, east = F.col("west") - wide, F.when(F.col("east") < F.col("west"), F.col("east") + 360).otherwise(F.col("east")) + wide
    out = boxes.withColumns({"south": F.greatest(F.lit(-90.0), F.col("south") - more), "north": F.least(F.lit(90.0), F.col("north") + more), "west": west, "east": east})
    around = F.col("east") - F.col("west") >= 360
    begin = F.pmod(F.col("west") + 180, F.lit(360.0)) - 180
    end = begin + F.col("east") - F.col("west")
    part = lambda w, e: F.struct(w.alias("west"), e.alias("east"))
    parts = F.when(around, F.array(part(F.lit(-180.0), F.lit(180.0)))).when(end > 180, F.array(part(begin, F.lit(180.0)), part(F.lit(-180.0), end - 360))).otherwise(F.array(part(begin, end)))
    return out.withColumn("_p", F.explode(parts)).withColumns({"west": F.col("_p.west"), "east": F.col("_p.east")}).drop("_p")


def grid_in_boxes(grid: DataFrame, boxes: DataFrame, km: float = 0.0) -> DataFrame:
    """Cells of ``grid`` (lat, lon, ...; longitudes of either count) with each region that holds them, once."""
    placed = grid.withColumn("lon", F.pmod(F.col("lon") + 180, F.lit(360.0)) - 180)
    parts = widened(boxes, km)
    return box_join(placed, parts)


def region_features(grid: DataFrame, boxes: DataFrame, features: list[Feature], km: float = 0.0, ts: str = "ts") -> DataFrame:
    """``name, ts`` and ``<feature>_<stat>`` over the cells of each region (name, south, west, north, east, bearing_deg) at each time.

    Values that are no numbers don't count; a feature without values at a time is null there.
    """
    held, stats = grid_in_boxes(grid, boxes, km), []
    for f in features:
        x = f.value(F.col("bearing_deg"))
        stats += [(F.avg(x) if s == "mean" else F.percentile(x, F.lit(SHARES[s]))).alias(f"{f.name}_{s}") for s in f.stats]
    return held.groupBy("name", ts).agg(*stats)


def region_metrics(grid: DataFrame, boxes: DataFrame, features: list[Feature], km: float = 0.0, ts: str = "ts") -> DataFrame:
    """``region_features`` over all times together, with the number of cells and times and the newest time."""
    held = grid_in_boxes(grid, boxes, km)
    whole = region_features(grid.withColumn("_all", F.lit(0)), boxes, features, km, "_all").drop("_all")
    counts = held.groupBy("name").agg(F.count(F.lit(1)).alias("cells"), F.countDistinct(ts).alias("times"), F.max(ts).alias("newest"))
    return whole.join(counts, "name")
