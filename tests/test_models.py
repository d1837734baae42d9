"""Gapped folds, calibration on out-of-fold scores, reliability."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import daily, models


@pytest.mark.parametrize("n", [1, 3, 6, 12, 13, 20, 40, 77, 120, 190, 500, 5000])
def test_splits_keep_their_gap_and_end_with_the_days(n):
    plan = models.time_splits(n)
    for trained, start, end in plan:
        assert 0 < trained < start < end <= n and start - trained == min(7, max(n // 4, 1) if n <= 12 else 7)
    assert all(a[2] == b[1] for a, b in zip(plan, plan[1:])) and (not plan or plan[-1][2] == n)
    if n >= 190:
        assert len(plan) == 5 and all(end - start == 30 for _, start, end in plan)
    if 12 < n < 190:
        assert 2 <= len(plan) <= 5
    assert plan or n < 4


def overconfident(spark, n=4000):
    """Scores whose true rate is halfway between them and one half."""
    rng = np.random.default_rng(4)
    p = rng.random(n)
    y = rng.random(n) < 0.25 + 0.5 * p
    return spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, target int")


def test_calibration_rises_with_the_score_and_lowers_the_brier_score(spark):
    train, test = overconfident(spark).randomSplit([0.5, 0.5], seed=1)
    model = models.calibrator(train)
    rows = models.calibrated(model, test).orderBy("p").select("p", "calibrated", "target").collect()
    values = [r.calibrated for r in rows]
    assert all(a <= b + 1e-12 for a, b in zip(values, values[1:])) and 0 <= values[0] and values[-1] <= 1
    brier = lambda c: np.mean([(r[c] - r.target) ** 2 for r in rows])
    assert brier("calibrated") < brier("p") - 0.01
    beyond = models.calibrated(model, spark.createDataFrame([(-1.0,), (2.0,)], "p double")).orderBy("p").collect()
    assert (beyond[0].calibrated, beyond[1].calibrated) == (pytest.approx(values[0], abs=0.1), pytest.approx(values[-1], abs=0.1))
    # pool adjacent violators by hand: 1, 0 become one half each
    steps = models.calibrator(spark.createDataFrame([(0.1, 0), (0.2, 1), (0.3, 0), (0.4, 1)], "p double, target int"))
    told = models.calibrated(steps, spark.createDataFrame([(0.1,), (0.2,), (0.3,), (0.4,)], "p double")).orderBy("p").collect()
    assert [r.calibrated for r in told] == [0.0, 0.5, 0.5, 1.0]


def test_reliability_of_equal_bins(spark):
    df = overconfident(spark, 1000)
    table = {r.bin: r for r in models.reliability(df, "p").collect()}
    rows = sorted((r.p, r.target) for r in df.collect())
    assert sorted(table) == list(range(10)) and all(table[b].n == 100 for b in table)
    for b in table:
        own = rows[100 * b : 100 * b + 100]
        assert (table[b].predicted, table[b].observed) == (pytest.approx(np.mean([x for x, _ in own])), pytest.approx(np.mean([y for _, y in own])))
    assert models.reliability(df.limit(0), "p").count() == 0


def test_out_of_fold_scores_are_of_later_days(spark):
    days = spark.range(150).select(F.expr("date_add(DATE '2024-01-01', CAST(id AS INT))").alias("d"), F.sin(F.col("id") * 0.9).alias("a"), F.cos(F.col("id") * 1.7).alias("b"))
    rows = days.withColumn("target", (F.col("a") + 0.2 * F.col("b") > 0).cast("int"))
    found = models.out_of_fold(rows, ["a", "b"], splits=2)
    per = {r.fold: (r.n, str(r.first), str(r.last)) for r in found.groupBy("fold").agg(F.count("*").alias("n"), F.min("d").alias("first"), F.max("d").alias("last")).collect()}
    assert per == {0: (30, "2024-03-31", "2024-04-29"), 1: (30, "2024-04-30", "2024-05-29")}
    assert models.scores(found)["auc"] > 0.9
    assert models.out_of_fold(rows.limit(2), ["a", "b"]).count() == 0


def test_components_that_tell_nothing_are_left_out(spark):
    rows = spark.range(40).select(F.sin("id").alias("a"), F.lit(1.0).alias("b"), F.when(F.col("id") < 29, F.col("id")).cast("double").alias("c"), F.when(F.col("id") < 31, F.col("id") * 1.0).otherwise(float("nan")).alias("e"))
    assert daily.telling_components(rows, ["a", "b", "c", "e"]) == ["a", "e"] and daily.telling_components(rows.limit(0), ["a"]) == []
