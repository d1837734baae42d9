"""Rates where the domains' posteriors overlap."""

import random

import numpy as np
import pytest

from tideline.llm import mixing


def members(spark, spread):
    rng = random.Random(5)
    good = [min(1.0, max(0.0, rng.gauss(0.5, spread))) for _ in range(2000)]
    rows = [(i, float(rng.randrange(50, 500)), [g, 1 - g]) for i, g in enumerate(good)]
    return spark.createDataFrame(rows, "row long, tokens double, p array<double>").cache(), rows


@pytest.mark.parametrize("spread", [0.05, 0.1, 0.3])
def test_overlapping_posteriors_reach_their_targets(spark, spread):
    table, rows = members(spark, spread)
    targets = np.array([0.6, 0.4]) * sum(t for _, t, _ in rows)
    fitted, history = mixing.fit_rates(table, targets)
    rate = {r.row: r.rate for r in table.select("row", fitted.alias("rate")).collect()}
    got = sum(rate[i] * t * np.array(p) for i, t, p in rows)
    assert min(rate.values()) >= 0 and got == pytest.approx(targets, rel=1e-4) and history[-1] == pytest.approx(got, rel=1e-6)


def test_rates_of_at_least_one_reach_the_shares(spark):
    table, rows = members(spark, 0.1)
    fitted, _, _ = mixing.rates(table, {"good": 0.6, "poor": 0.4}, least=1.0)
    rate = {r.row: r.rate for r in table.select("row", fitted.alias("rate")).collect()}
    got = sum(rate[i] * t * np.array(p) for i, t, p in rows)
    assert min(rate.values()) >= 1 and got / got.sum() == pytest.approx([0.6, 0.4], rel=2e-3)


def test_shares_out_of_reach_are_told(spark):
    table, _ = members(spark, 0.02)
    with pytest.warns(UserWarning, match="shares attained"):
        mixing.rates(table, {"good": 0.99, "poor": 0.01})


def nonnegative_least_squares(a, b):
    """Lawson and Hanson's method."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    while True:
        slope = a.T @ (b - a @ x)
        if free.all() or slope[~free].max() < 1e-7:
            return x
        free[np.where(free, -np.inf, slope).argmax()] = True
        while True:
            z = np.zeros_like(x)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if z[free].min() > 0:
                break
            down = free & (z <= 0)
            x = x + (x[down] / (x[down] - z[down])).min() * (z - x)
            free &= x > 1e-12
        x = z


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_rates_are_those_of_nonnegative_least_squares(spark, share):
    rng = random.Random(8)
    rows = [(i, float(rng.randrange(5, 50)), [g := rng.random() ** 2, 1 - g]) for i in range(40)]
    tokens, p = np.array([t for _, t, _ in rows]), np.array([p for _, _, p in rows])
    targets = np.array([share, 1 - share]) * tokens.sum()
    table = spark.createDataFrame(rows, "row long, tokens double, p array<double>")
    fitted, _ = mixing.fit_rates(table, targets)
    rate = {r.row: r.rate for r in table.select("row", fitted.alias("rate")).collect()}
    # distance from 1 by tokens, and the targets at a weight that makes them hold
    a = np.concatenate([np.diag(np.sqrt(tokens)), 1e4 * (tokens[:, None] * p).T])
    want = nonnegative_least_squares(a, np.concatenate([np.sqrt(tokens), 1e4 * targets]))
    assert [rate[i] for i in range(40)] == pytest.approx(want.tolist(), abs=2e-3)


def test_rates_within_bounds(spark):
    table, rows = members(spark, 0.3)
    targets = sum((1.7 if p[0] > 0.5 else 1.2) * t * np.array(p) for _, t, p in rows)
    fitted, _ = mixing.fit_rates(table, targets, least=1.0, most=2.0)
    rate = {r.row: r.rate for r in table.select("row", fitted.alias("rate")).collect()}
    got = sum(rate[i] * t * np.array(p) for i, t, p in rows)
    assert min(rate.values()) >= 1 and max(rate.values()) <= 2 and got == pytest.approx(targets, rel=1e-4)
