"""Daily components and composite indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.columns import clip, safe_z, sigmoid
from tideline.operators.seasonal import doy_baseline


def component_z(raw: Column | str, mean: Column | str, std: Column | str, sign: int = 1) -> Column:
    """``sign (x - mean) / std`` within 5; null if any is null or the deviation is 0."""
    return clip(F.lit(float(sign)) * safe_z(raw, mean, std), -5.0, 5.0)


def missing_reason(raw: str = "raw_value", mean: str = "mean", std: str = "std") -> Column:
    return (
        F.when(F.col(raw).isNull(), "no_data").when(F.col(mean).isNull() | F.col(std).isNull(), "baseline_missing").when(F.col(std) == 0, "flat_baseline")
    )


def components_daily(inputs: DataFrame, signs: DataFrame) -> DataFrame:
    """``d, basin, comp, raw_value, z_value, missing_reason`` for every basin, component and day that any input has.

    ``inputs`` is ``d, basin, comp, raw_value``; ``signs`` (a small dimension) gives each component's sign.
    """
    days = inputs.select("d").distinct()
    # one row for each basin and component: a dimension
    spec = inputs.select("basin", "comp").distinct().join(signs, "comp")
    grid = days.join(F.broadcast(spec))
    base = doy_baseline(inputs.withColumnRenamed("raw_value", "x"), ["basin", "comp"])
    joined = (
        grid.join(inputs, ["d", "basin", "comp"], "left")
        .withColumn("doy", F.dayofyear("d"))
        .join(base.select("basin", "comp", "doy", "mean", "std"), ["basin", "comp", "doy"], "left")
    )
    z = clip(F.col("sign") * safe_z("raw_value", "mean", "std"), -5.0, 5.0)
    return joined.select("d", "basin", "comp", "raw_value", z.alias("z_value"), missing_reason().alias("missing_reason"))


def composite(components: DataFrame, parts: tuple[str, str], name: str) -> DataFrame:
    """Two components as one: mean of both z (null if either is), sum of the raw values there are, and why z is missing."""
    a, b = (F.max(F.when(F.col("comp") == p, F.col("z_value"))) for p in parts)
    raw = F.sum(F.when(F.col("comp").isin(*parts), F.col("raw_value")))
    pair = components.where(F.col("comp").isin(*parts)).groupBy("d", "basin").agg(a.alias("a"), b.alias("b"), raw.alias("raw_value"))
    reason = F.when(F.col("a").isNull() & F.col("b").isNull(), "both_missing").when(F.col("a").isNull(), f"{parts[0]}_missing").when(
        F.col("b").isNull(), f"{parts[1]}_missing"
    )
    return pair.select("d", "basin", F.lit(name).alias("comp"), "raw_value", ((F.col("a") + F.col("b")) / 2).alias("z_value"), reason.alias("missing_reason"))


def basin_index(components: DataFrame) -> DataFrame:
    """``100 exp(mean z)`` by basin and day, with the number of components present."""
    return components.groupBy("d", "basin").agg(
        (F.lit(100.0) * F.exp(F.avg("z_value"))).alias("level"), F.count("z_value").alias("present")
    )


def global_index(basins: DataFrame) -> DataFrame:
    """Geometric mean of the basins' levels."""
    return basins.groupBy("d").agg((F.lit(100.0) * F.exp(F.avg(F.ln(F.col("level") / 100.0)))).alias("level"), F.count("level").alias("basins"))


def lite_index(matrix: DataFrame, weights: dict[str, float], d: str = "d", left_out: str | None = None) -> DataFrame:
    """``100 exp(weighted mean)``, its change, and the variant without one component; ties round to even."""

    def level(w: dict[str, float]) -> Column:
        total = sum((F.col(c) * F.lit(x) for c, x in w.items()), F.lit(0.0))
        return F.bround(F.lit(100.0) * F.exp(total / F.lit(sum(w.values()))), 2)

    order = Window.orderBy(d)
    out = matrix.withColumn("index", level(weights))
    out = out.withColumn("change", F.round(F.col("index") - F.lag("index").over(order), 2))
    if left_out:
        out = out.withColumn("index_without", level({c: w for c, w in weights.items() if c != left_out}))
    return out


def _middle(ordered: Column) -> Column:
    """Median of a sorted array."""
    half = F.floor(F.size(ordered) / 2).cast("int")
    return F.when(F.size(ordered) % 2 == 1, F.get(ordered, half).cast("double")).otherwise((F.get(ordered, half - 1) + F.get(ordered, half)) / 2.0)


def flux_scores(daily: DataFrame, days: int = 30, gate: str = "gate_id", d: str = "ds", x: str = "crossings") -> DataFrame:
    """Robust score of each day among the gate's last ``days`` and itself: sigmoid of ``(x - med) / MAD / 1.5``; 0.5 where MAD is 0."""
    at = F.unix_date(d)
    frame = Window.partitionBy(gate).orderBy(at).rangeBetween(-days, 0)
    seen = daily.withColumn("_xs", F.array_sort(F.collect_list(x).over(frame))).withColumn("med", _middle(F.col("_xs")))
    off = F.array_sort(F.transform("_xs", lambda v: F.abs(v - F.col("med"))))
    seen = seen.withColumn("_off", off).withColumn("mad", _middle(F.col("_off"))).drop("_xs", "_off")
    score = F.when(F.col("mad") > 0, sigmoid((F.col(x) - F.col("med")) / F.col("mad") / 1.5)).otherwise(0.5)
    return seen.withColumn("score", score)


def index_v15(scores: DataFrame, weights: DataFrame, gate: str = "gate_id", d: str = "ds") -> DataFrame:
    """Weighted mean of ``.7 flux + .3 sis`` (sis where known, else flux alone) times 200, and the coverage of weights.

    ``weights`` is a small dimension; gates of weight 0 don't count but their weights do in the coverage.
    """
    sis = clip(F.col("sis"), 0.0, 1.0)
    stress = F.when(F.col("sis").isNotNull(), 0.7 * F.col("score") + 0.3 * sis).otherwise(F.col("score"))
    joined = scores.join(weights, gate).withColumn("stress", stress)
    return joined.groupBy(d).agg(
        (F.lit(200.0) * F.sum(F.col("stress") * F.col("weight")) / F.nullif(F.sum("weight"), F.lit(0.0))).alias("level"),
        F.sum("weight").alias("weight_present"),
        F.count(F.lit(1)).alias("gates"),
    )


def coverage(components: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Share of the last ``days`` on which a basin had any z, and components present against those expected."""
    recent = components.where((F.col("d") > F.date_sub(as_of, days)) & (F.col("d") <= as_of))
    daily = recent.groupBy("basin", "d").agg(F.max(F.col("z_value").isNotNull().cast("int")).alias("any_z"))
    shares = daily.groupBy("basin").agg((F.sum("any_z") / F.lit(float(days))).alias("coverage"))
    parts = recent.groupBy("basin").agg(
        F.countDistinct(F.when(F.col("z_value").isNotNull(), F.col("comp"))).alias("present"), F.countDistinct("comp").alias("expected")
    )
    return shares.join(parts, "basin")
