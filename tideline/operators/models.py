"""Direction and throughput models on daily series, with chronological folds, drift and damping."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def balanced_weights(rows: DataFrame, label: str) -> DataFrame:
    """``weight`` that gives both classes the same sum."""
    n, ones = rows.agg(F.count(F.lit(1)), F.sum(label)).first()
    share = min(max((ones or 0) / max(n, 1), 1e-6), 1 - 1e-6)
    return rows.withColumn("weight", F.when(F.col(label) == 1, 0.5 / share).otherwise(0.5 / (1 - share)))


def fit_direction(rows: DataFrame, features: list[str], label: str = "target") -> PipelineModel:
    """Scaled, balanced logistic regression."""
    stages = [
        VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="skip"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        LogisticRegression(labelCol=label, weightCol="weight", regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(balanced_weights(rows.dropna(subset=[label, *features]), label))


def probability(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("p", vector_to_array("probability")[1]).drop("raw", "features", "rawPrediction", "probability")


def time_folds(rows: DataFrame, d: str, folds: int, gap: int) -> list[tuple[DataFrame, DataFrame]]:
    """Growing training spans and the span after each, with ``gap`` rows between them."""
    total = rows.count()
    size = total // (folds + 1)
    # a daily series: as many rows as days
    numbered = rows.withColumn("_i", F.row_number().over(Window.orderBy(d)))
    out = []
    for k in range(1, folds + 1):
        end = k * size
        train = numbered.where(F.col("_i") <= end - gap).drop("_i")
        test = numbered.where((F.col("_i") > end) & (F.col("_i") <= end + size)).drop("_i")
        out.append((train, test))
    return out


def scores(predicted: DataFrame, label: str = "target", p: str = "p") -> dict[str, float]:
    """AUC, area under precision and recall, and Brier score."""
    known = predicted.where(F.col(label).isNotNull()).withColumn("_l", F.col(label).cast("double"))
    auc = BinaryClassificationEvaluator(rawPredictionCol=p, labelCol="_l", metricName="areaUnderROC").evaluate(known)
    pr = BinaryClassificationEvaluator(rawPredictionCol=p, labelCol="_l", metricName="areaUnderPR").evaluate(known)
    brier = known.agg(F.avg(F.pow(F.col(p) - F.col("_l"), 2))).first()[0]
    return {"auc": auc, "pr_auc": pr, "brier": brier}


def fit_throughput(rows: DataFrame, features: list[str], label: str, classify: bool) -> PipelineModel:
    """Boosted trees for the sign (``classify``) or the size of a coming change."""
    kind = GBTClassifier if classify else GBTRegressor
    stages = [VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), kind(labelCol=label, maxIter=20, maxDepth=3, seed=7)]
    return Pipeline(stages=stages).fit(rows.dropna(subset=[label, *features]))


def psi(base: DataFrame, now: DataFrame, x: str, edges: list[float]) -> DataFrame:
    """Population stability index of two samples over bins between ``edges`` (the last one closed); what lies outside is left out.

    The ratio of the shares is kept above 1e-6, not the shares; null where a sample has no rows.
    """
    number = sum((F.col("x") >= e).cast("int") for e in edges[:-1]) - 1
    rows = base.select(F.col(x).alias("x"), F.lit(1).alias("b"), F.lit(0).alias("n")).union(now.select(F.col(x), F.lit(0), F.lit(1))).where(F.col("x").isNotNull())
    # at most as many rows as bins, and one of what lies outside
    bins = rows.withColumn("bin", F.when(F.col("x").between(edges[0], edges[-1]), number)).groupBy("bin").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
    whole, inside = Window.partitionBy(), F.col("bin").isNotNull()
    total = lambda c: F.greatest(F.sum(F.when(inside, F.col(c)).otherwise(0)).over(whole), F.lit(1))
    shares = bins.select("bin", (F.col("b") / total("b")).alias("p"), (F.col("n") / total("n")).alias("q"), F.sum("b").over(whole).alias("bs"), F.sum("n").over(whole).alias("ns"))
    ratio = F.greatest(F.col("q") / F.greatest("p", F.lit(1e-6)), F.lit(1e-6))
    part = F.when(inside, (F.col("q") - F.col("p")) * F.log(ratio)).otherwise(0.0)
    return shares.agg(F.when((F.max("bs") > 0) & (F.max("ns") > 0), F.sum(part)).alias("psi"))


def ks(base: DataFrame, now: DataFrame, x: str) -> DataFrame:
    """Kolmogorov-Smirnov distance: the largest gap of the two cumulative shares, over distinct values."""
    rows = base.select(F.col(x).alias("x"), F.lit(1).alias("b"), F.lit(0).alias("n")).union(now.select(x, F.lit(0), F.lit(1)))
    by_value = rows.where(F.col("x").isNotNull()).groupBy("x").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
    so_far, whole = Window.orderBy("x"), Window.partitionBy()
    gap = F.abs(F.sum("b").over(so_far) / F.sum("b").over(whole) - F.sum("n").over(so_far) / F.sum("n").over(whole))
    return by_value.select(gap.alias("g")).agg(F.max("g").alias("ks"))


def time_splits(n: int, splits: int = 5, gap: int = 7, size: int = 30) -> list[tuple[int, int, int]]:
    """(end of training, start of the test, its end) for tests of ``size`` at the end of ``n`` steps, ``gap`` steps behind their training.

    Short histories get fewer and shorter tests; a test without any training before it is left out.
    """
    if n <= gap + 5:
        splits, gap, size = 2, min(gap, max(n // 4, 1)), max(1, n // 3)
    else:
        splits = min(splits, max(2, (n - gap) // size - 1))
        size = min(size, max(1, (n - gap) // (splits + 1)))
    starts = range(n - splits * size, n, size)
    return [(start - gap, start, start + size) for start in starts if start > gap]


def out_of_fold(rows: DataFrame, features: list[str], d: str = "d", label: str = "target", splits: int = 5, gap: int = 7, size: int = 30) -> DataFrame:
    """``d, label, p, fold``: scores of the direction model for days it wasn't trained on, in folds of ``time_splits`` over the days of ``rows``."""
    known = rows.dropna(subset=[label, *features])
    # one row for each day
    days = known.select(d).distinct().withColumn("_i", F.row_number().over(Window.orderBy(d)) - 1)
    plan = time_splits(days.count(), splits, gap, size)
    ends = {i for split in plan for i in (split[0] - 1, split[1], split[2] - 1)}
    at = {r["_i"]: r[d] for r in days.where(F.col("_i").isin(list(ends))).collect()}
    found = None
    for k, (trained, start, end) in enumerate(plan):
        train, test = known.where(F.col(d) <= at[trained - 1]), known.where(F.col(d).between(at[start], at[end - 1]))
        if len(train.select(label).distinct().limit(2).collect()) < 2:
            continue
        scored = probability(fit_direction(train, features, label), test).select(d, label, "p", F.lit(k).alias("fold"))
        found = scored if found is None else found.union(scored)
    if found is None:
        return known.select(d, label, F.lit(None).cast("double").alias("p"), F.lit(0).alias("fold")).limit(0)
    return found


def calibrator(scored: DataFrame, label: str = "target", p: str = "p"):
    """A step function that rises with the score, fitted to the labels of out-of-fold scores; beyond them it stays level."""
    known = scored.where(F.col(label).isNotNull() & F.col(p).isNotNull()).select(F.col(p).alias("p"), F.col(label).cast("double").alias("y"))
    return IsotonicRegression(featuresCol="p", labelCol="y", predictionCol="calibrated").fit(known)


def calibrated(model, scored: DataFrame, p: str = "p") -> DataFrame:
    """``scored`` with ``calibrated``, the probability that the step function gives the score."""
    named = scored if p == "p" else scored.withColumn("p", F.col(p))
    return model.transform(named)


def reliability(scored: DataFrame, p: str = "calibrated", label: str = "target", bins: int = 10) -> DataFrame:
    """``bin, n, predicted, observed`` over bins that hold equal numbers of rows, as far as ties allow."""
    known = scored.where(F.col(p).isNotNull() & F.col(label).isNotNull())
    edges = known.agg(F.percentile(p, F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("_e"))
    # one row of bins - 1 numbers
    numbered = known.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("_e", lambda e: e < F.col(p))))
    return numbered.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("predicted"), F.avg(F.col(label).cast("double")).alias("observed"))


def damped(before: Column, now: Column, step: float = 0.05) -> Column:
    """The new probability unless it moved by at most ``step``, in which case the old one stays."""
    return F.when(before.isNull() | (F.abs(now - before) > step), now).otherwise(before)


def metrics_frame(rows: DataFrame, features: list[str], d: str = "d", label: str = "target", folds: int = 3, gap: int = 5) -> DataFrame:
    """Out-of-fold scores of the direction model, a row for each fold."""
    spark, found = rows.sparkSession, []
    for k, (train, test) in enumerate(time_folds(rows, d, folds, gap)):
        s = scores(probability(fit_direction(train, features, label), test.dropna(subset=[label, *features])), label)
        found.append((k, float(s["auc"]), float(s["pr_auc"]), float(s["brier"])))
    return spark.createDataFrame(found, "fold int, auc double, pr_auc double, brier double")
