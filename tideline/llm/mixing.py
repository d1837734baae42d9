"""Mixing sources to target weights, with soft membership.

A classifier fitted to a labelled table gives each document's posteriors over the domains. Of all rates (how often
a document is to be used) that are within bounds and give each domain its target, the sum of rate x tokens x
posterior, those nearest to 1 are the projection of a linear function of the posteriors. Its one weight per domain is
found by Newton's method: an iteration is one aggregation to the domains' totals and the products of their posteriors.

Cases: a null text is an empty one, with no tokens and the rate its posteriors give; texts of any length are read
whole; repeated rows are documents of their own; a domain without any mass can't reach its target, the rest still
fits; an empty table gives no rows; extra columns, whatever their names, are kept by ``mixed`` and ignored by
``document_rates``. Tokens are runs without white space.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm import classifier
from tideline.llm.shared import stored

#: Weight of the rates' distance from 1 beside the totals' distance from the targets.
MU = 1e-10
#: Totals count as at their targets within this share of them.
REACHED = 1e-3
#: Factors by which the total may grow so that rates of at least 1 meet the targets; without growth the scarcest
#: target leaves its domain no freedom.
GROWTH = (1.02, 1.05, 1.1, 1.2, 1.4, 1.8, 2.6, 4.2, 8.0, 16.0)
#: Weights beyond this mean targets that no rates reach.
LARGEST_WEIGHT = 1e4
#: ``mixed`` repeats no document more often; shares that would need more are told by a warning.
MOST_COPIES = 8.0


def reached(totals: np.ndarray, targets: np.ndarray) -> bool:
    return bool(np.all(np.abs(totals - targets) <= REACHED * np.maximum(targets, targets.sum() * 1e-6)))


def fit_rates(
    members: DataFrame,
    targets: np.ndarray,
    least: float = 0.0,
    most: float = math.inf,
    tokens: str = "tokens",
    p: str = "p",
    iterations: int = 64,
    close: float = 1e-6,
) -> tuple[Column, list[np.ndarray]]:
    """The rate of a row of ``members`` as a column of its array ``p``, and the domains' totals at each iteration.

    ``members`` is a stored table with columns ``tokens`` and ``p``. The fit ends at its
    targets, or where a weight shows that no rates reach them: the last totals tell (``reached``).
    """
    k = len(targets)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    size = max(float(targets.sum()), 1e-9)

    def rated(x: np.ndarray) -> tuple[Column, Column]:
        free = F.lit(1.0)
        for i, v in enumerate(x):
            free = free + F.col(p)[i] * F.lit(float(v))
        return free, F.least(F.greatest(free, F.lit(float(least))), F.lit(float(most)))

    def at(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Value of the dual, totals, and curvature over the rows whose rate can move."""
        free, rate = rated(x)
        value = F.col(tokens) * (rate * free - rate * rate / 2)
        moving = F.when((free > F.lit(float(least))) & (free < F.lit(float(most))), F.col(tokens)).otherwise(0.0)
        found = members.agg(
            F.sum(value),
            *[F.sum(F.col(tokens) * rate * F.col(p)[i]) for i in range(k)],
            *[F.sum(moving * F.col(p)[i] * F.col(p)[j]) for i, j in pairs],
        ).first()
        found, curve = [v or 0.0 for v in found], np.zeros((k, k))
        for (i, j), v in zip(pairs, found[1 + k :]):
            curve[i, j] = curve[j, i] = v
        return found[0] - targets @ x + MU * size * (x @ x) / 2, np.array(found[1 : 1 + k]), curve

    x, history = np.zeros(k), []
    value, now, curve = at(x)
    for _ in range(iterations):
        history.append(now)
        slope = now - targets + MU * size * x
        if np.all(np.abs(slope) <= close * np.maximum(targets, size * 1e-9)):
            break
        step = np.linalg.solve(curve + MU * size * np.eye(k), slope)
        step *= min(1.0, LARGEST_WEIGHT / max(np.abs(step).max(), 1e-300))
        length, gain = 1.0, slope @ step
        # at the limit of what sums of doubles tell apart
        if gain <= 1e-15 * max(1.0, abs(value)):
            break
        while length > 1e-9:
            found = at(x - length * step)
            if found[0] <= value - 1e-4 * length * gain + 1e-14 * abs(value):
                break
            length /= 2
        x, (value, now, curve) = x - length * step, found
        if np.abs(x).max() > LARGEST_WEIGHT:
            history.append(now)
            break
    return rated(x)[1], history


def memberships(docs: DataFrame, labels: DataFrame, label: Column, domains: list[str], id_col: str, text_col: str) -> DataFrame:
    """The columns of ``docs`` as ``c0, c1, ...`` with ``tokens`` and ``p``, stored."""
    model = classifier.fit(docs, labels, label, domains, id_col=id_col, text_col=text_col)
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return stored(classifier.with_posteriors(numbered, model, f"c{docs.columns.index(text_col)}", "tokens", "p"), "memberships")


def rates(
    members: DataFrame, weights: dict[str, float], least: float = 0.0, most: float = math.inf
) -> tuple[Column, list[np.ndarray], np.ndarray]:
    """The rate, as a column, of stored ``memberships``; with ``least`` 1 the total grows until the domains have their shares.

    Warns with the shares attained where no rates tried meet the targets.
    """
    slim = members.select(F.col("tokens").cast("double").alias("tokens"), "p")
    share = np.array(list(weights.values())) / sum(weights.values())
    found = slim.agg(*[F.sum(F.col("tokens") * F.col("p")[i]) for i in range(len(share))]).first()
    now = np.array([x or 0.0 for x in found])
    total = now.sum() if least < 1 else (now[share > 0] / share[share > 0]).max()
    fits = []
    for growth in GROWTH if least >= 1 else (1.0,):
        targets = share * total * growth
        fits.append((*fit_rates(slim, targets, least, most), targets))
        if reached(fits[-1][1][-1], targets):
            return fits[-1]
    # the fit with the least miss
    fitted = min(fits, key=lambda f: np.abs(f[1][-1] - f[2]).sum() / max(f[2].sum(), 1e-9))
    got = fitted[1][-1]
    warnings.warn(f"shares attained {dict(zip(weights, (got / max(got.sum(), 1e-9)).tolist()))}, wanted {dict(zip(weights, share.tolist()))}")
    return fitted


def document_rates(
    docs: DataFrame, labels: DataFrame, label: Column, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, tokens, p_<domain>..., rate`` of each row; ``weights`` gives the domains' shares of the tokens."""
    domains = list(weights)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    members = memberships(rows, labels, label, domains, "doc_id", "text")
    rate, _, _ = rates(members, weights)
    return members.select(F.col("c0").alias("doc_id"), "tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)], rate.alias("rate"))


def mixed(
    docs: DataFrame,
    labels: DataFrame,
    label: Column,
    weights: dict[str, float],
    id_col: str = "doc_id",
    text_col: str = "text",
    most: float = MOST_COPIES,
) -> DataFrame:
    """``docs`` with each row as often as its rate says, once at least and ``most`` times at most.

    A fraction of a copy is decided by a hash of the row's id and text.
    """
    at = docs.columns.index
    members = memberships(docs, labels, label, list(weights), id_col, text_col)
    rate, _, _ = rates(members, weights, least=1.0, most=most)
    rated = members.withColumn("rate", rate)
    chance = F.pmod(F.xxhash64(f"c{at(id_col)}", f"c{at(text_col)}"), F.lit(1 << 24)) / float(1 << 24)
    copies = F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")
    repeated = rated.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    return repeated.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(docs.columns)])
