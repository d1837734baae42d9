"""Toxicity by weak supervision.

Words and word beginnings that labelled rows tie to toxic texts are dealt to many voters, beside voters on writing
style. A generative label model, fitted by expectation maximisation to the votes on labelled and unlabelled texts
(labels give its start where there are any), estimates how often each voter fires on either class and how voters
correlate given the class; correlated voters share their weight. Its posteriors are the labels of a linear classifier
on the voters' hits, which scores texts.

Everything fitted comes from at most ``max_labelled`` labelled and as many unlabelled rows, none of them held out,
those first in the order of a hash of the id; all rows are scored, whole. The lexicon holds every trait whose gain is
beyond what chance gives the best of as many traits. Labels, language, source and id are no inputs of a score.

Cases: a null text is an empty one, without hits; texts of any length are read whole; a row with a null id is scored
and is not held out; of repeated labels of an id the larger counts, of several texts of an id all are trained on; rows
with null labels are unlabelled; without labels of both classes every score is 0; without telling words the style
voters are left; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.shared import Kept, small_batches, stored

WORD = re.compile(r"[^\W\d_]+")
STEM = 5
WORD_VOTERS, STEM_VOTERS = 8, 6
STYLE = (re.compile(r"\b[A-ZÀ-Þ]{4,}\b"), re.compile(r"[!?]{2,}"), re.compile(r"[a-z][0-9@$]+[a-z]"))
STYLES = len(STYLE)
VOTERS = WORD_VOTERS + STEM_VOTERS + STYLES
#: Bytes of words that a worker keeps with their voters.
KEPT_BYTES = 24 << 20


@dataclass
class Model:
    """``entries`` maps a word, or a beginning marked with ``^``, to its voter; the rest scores the voters' hits."""

    entries: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray | None = None
    accuracies: np.ndarray | None = None
    correlations: np.ndarray | None = None


def traits(text: str) -> set[str]:
    """The distinct words of a text in lower case, and their beginnings."""
    words = set(WORD.findall(text.lower()))
    return words | {f"^{w[:STEM]}" for w in words if len(w) >= STEM}


def style(text: str) -> tuple[int, int, int]:
    """Shouting, runs of marks, and digits inside words."""
    return tuple(len(p.findall(text)) for p in STYLE)


class Voters(Kept):
    """Maps a word to the voters it makes fire; most words have none."""

    def __init__(self, entries: dict[str, int]):
        super().__init__(KEPT_BYTES)
        self.entries = entries

    def make(self, word: str) -> tuple[int, ...]:
        own = [self.entries.get(word)]
        if len(word) >= STEM:
            own.append(self.entries.get(f"^{word[:STEM]}"))
        return tuple(v for v in own if v is not None)

    def hits(self, text: str) -> np.ndarray:
        """How many distinct words made each voter fire."""
        counts = np.zeros(VOTERS)
        for fired in map(self.__getitem__, set(WORD.findall(text.lower()))):
            for voter in fired:
                counts[voter] += 1
        counts[-STYLES:] = style(text)
        return counts


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def first_by_hash(ids: DataFrame, most: int) -> DataFrame:
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def labelled_rows(docs: DataFrame, labels: DataFrame, label_col: str, max_labelled: int) -> DataFrame:
    """``doc_id, text, y`` of at most ``max_labelled`` labelled ids that aren't held out, written to the shared folder."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~is_held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # of max_labelled rows at most
    return stored(texts.join(F.broadcast(first_by_hash(chosen, max_labelled)), "doc_id").distinct(), "labelled")


def unlabelled_rows(docs: DataFrame, labels: DataFrame, label_col: str, most: int) -> DataFrame:
    """``doc_id, text`` of at most ``most`` ids without label that aren't held out, written to the shared folder."""
    known = labels.where(F.col(label_col).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = texts.select("doc_id").where(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).join(known, "doc_id", "left_anti")
    # of at most as many rows
    return stored(texts.join(F.broadcast(first_by_hash(ids.distinct(), most)), "doc_id").distinct(), "unlabelled")


def telling_traits(rows: DataFrame) -> list[tuple[str, float]]:
    """Traits of positive rows with their likelihood-ratio gain, largest first.

    A gain counts from ``2 ln(traits) + 6`` on: of so many traits without meaning, chance lifts one in twenty sets of
    them that high. There are no more traits than the bounded number of labelled rows has words.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 64):
            found = [(t, y) for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()) for t in traits(text)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in found], pa.string()), pa.array([y for _, y in found], pa.int32())], names=["trait", "y"]
            )

    n, n1 = rows.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not n or not n1 or n1 == n:
        return []
    p = n1 / n
    k, k1 = F.col("k"), F.col("k1")
    q = k1 / k
    gain = 2 * (k1 * F.log(q / p) + F.when(k > k1, (k - k1) * F.log((1 - q) / (1 - p))).otherwise(0.0))
    counts = rows.select("text", "y").mapInArrow(run, "trait string, y int").groupBy("trait").agg(
        F.count(F.lit(1)).alias("k"), F.sum("y").alias("k1")
    )
    counts = stored(counts, "traits")
    least_gain = 2 * float(np.log(max(1, counts.count()))) + 6
    telling = counts.where((k1 > 0) & (q >= F.lit((1 + p) / 2))).withColumn("gain", gain).where(F.col("gain") >= least_gain)
    return [(r.trait, r.gain) for r in telling.orderBy(F.desc("gain"), "trait").collect()]


def hit_table(rows: DataFrame, entries: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hits and labels (nan where unknown) of a bounded number of rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(entries)
        for batch in small_batches(batches):
            hits = [voters.hits(t).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(hits, pa.list_(pa.float64()))], names=["y", "hits"])

    found = rows.select("text", F.col("y").cast("double").alias("y")).mapInArrow(run, "y double, hits array<double>").toArrow()
    hits = np.array(found.column("hits").to_pylist(), dtype=np.float64).reshape(-1, VOTERS)
    return hits, found.column("y").to_numpy().astype(np.float64)


def judged(fired: np.ndarray, rate: np.ndarray, correlation: np.ndarray, odds: float) -> np.ndarray:
    """Posteriors of class 1 from the votes; voters that fire together given the class share their weight."""
    weight = 1 / (1 + np.clip(correlation - np.eye(len(correlation)), 0, None).sum(axis=1))
    gain = fired * np.log(rate[1] / rate[0]) + (1 - fired) * np.log((1 - rate[1]) / (1 - rate[0]))
    return 1 / (1 + np.exp(-np.clip(np.log(odds) + gain @ weight, -30, 30)))


def label_model(fired: np.ndarray, start: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of class 1, firing rates by class and voter, and correlations of voters given the class.

    ``start`` holds labels, nan for rows without; these start from what the rates of the labelled rows say of them.
    """
    known = ~np.isnan(start)
    if not known.all():
        y, rate, correlation = label_model(fired[known], start[known], rounds)
        start = np.where(known, start, judged(fired, rate, correlation, y.sum() / (1 - y).sum()))
    y = np.clip(start, 0.02, 0.98)
    for _ in range(rounds):
        mass = np.stack([1 - y, y])
        rate = (mass @ fired + 0.5) / (mass.sum(axis=1, keepdims=True) + 1)
        residual = fired - (mass.T @ rate)
        cov = residual.T @ residual / len(fired)
        spread = np.sqrt(np.clip(np.diag(cov), 1e-9, None))
        correlation = cov / np.outer(spread, spread)
        before, y = y, judged(fired, rate, correlation, mass[1].sum() / mass[0].sum())
        if np.abs(y - before).max() < 1e-6:
            break
    return y, rate, correlation


def inputs(hits: np.ndarray) -> np.ndarray:
    """What the linear classifier sees: hits of each voter, whether it fired, both for all lexicon voters, and 1."""
    lexicon = hits[:, :-STYLES].sum(axis=1, keepdims=True)
    every = np.concatenate([hits, lexicon], axis=1)
    return np.concatenate([np.log1p(every), every > 0, np.ones((len(hits), 1))], axis=1)


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 40) -> np.ndarray:
    """Logistic regression on posterior labels by Newton's method."""
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_labelled: int = 12_000) -> Model:
    rows = labelled_rows(docs, labels, label_col, max_labelled)
    if len({r.y for r in rows.select("y").distinct().collect()}) < 2:
        return Model()
    entries: dict[str, int] = {}
    words = stems = 0
    for trait, _ in telling_traits(rows):
        if trait.startswith("^"):
            entries[trait] = WORD_VOTERS + stems % STEM_VOTERS
            stems += 1
        else:
            entries[trait] = words % WORD_VOTERS
            words += 1
    others = unlabelled_rows(docs, labels, label_col, max_labelled).withColumn("y", F.lit(None).cast("int"))
    hits, y = hit_table(rows.union(others), entries)
    posterior, rates, correlations = label_model((hits > 0).astype(np.float64), y)
    return Model(entries, fit_linear(inputs(hits), posterior), rates, correlations)


class Scorer:
    """Scores texts in a worker."""

    def __init__(self, model: Model):
        self.weights, self.voters = model.weights, Voters(model.entries)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        hits = np.array([self.voters.hits(t.as_py() or "") for t in texts]).reshape(-1, VOTERS)
        return 1 / (1 + np.exp(-np.clip(inputs(hits) @ self.weights, -30, 30)))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in small_batches(batches):
            found = pa.array(scorer(batch.column("text")), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of ``docs``."""
    return scores(docs, fit(docs, labels)).select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    model, at = fit(docs, labels), docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in small_batches(batches):
            yield batch.filter(pa.array(scorer(batch.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)
