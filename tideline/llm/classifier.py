"""A linear (softmax) classifier of texts on style measures and words that tell classes apart.

It is fitted on at most ``max_labelled`` labelled rows, those first in the order of a hash of the id, and scores
texts whole. Used by the quality classifier and by source mixing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.shared import small_batches, stored
from tideline.llm.toxicity import STEM, WORD, telling_traits

#: Kinds of bytes whose shares of a text are measured.
KINDS = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"abcdefghijklmnopqrstuvwxyz",
    b"0123456789",
    b" \t\r",
    b"\n",
    b".,;:?-'\"",
    b"|",
    b"!",
    b"#$%&*+=^~@_",
    b"<>()[]{}/\\",
    bytes(range(128, 256)),
)
KIND_OF = np.zeros((256, len(KINDS)))
for _i, _kind in enumerate(KINDS):
    KIND_OF[list(_kind), _i] = 1


@dataclass
class Model:
    """``entries`` maps a word, or a beginning marked with ``^``, to its class; ``weights`` has a column for each class."""

    classes: list[str]
    entries: dict[str, int] = field(default_factory=dict)
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None


class Measures:
    """Measures texts; ``words`` and ``stems`` map telling words and beginnings to their classes."""

    def __init__(self, model: Model):
        self.model = model
        self.words = {w: c for w, c in model.entries.items() if not w.startswith("^")}
        self.stems = {w[1:]: c for w, c in model.entries.items() if len(w) == STEM + 1 and w.startswith("^")}

    def hits(self, distinct: set[str]) -> np.ndarray:
        """How many distinct words speak for each class; ``distinct`` are the runs without white space of a text."""
        counts = np.zeros(len(self.model.classes))
        # no word, and no lower case of one, depends on what stands beyond white space
        found, stems = set(WORD.findall(" ".join(distinct).lower())), self.stems
        for word in found & self.words.keys():
            counts[self.words[word]] += 1
        for stem in [s for w in found if (s := w[:STEM]) in stems]:
            counts[stems[stem]] += 1
        return counts

    def __call__(self, text: str) -> tuple[int, np.ndarray]:
        """Number of words (runs without white space) and the measures."""
        raw = text.encode()
        words = text.split()
        n, size = len(words), max(1, len(raw))
        shares = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) @ KIND_OF / size
        distinct = set(words)
        hits = self.hits(distinct) if self.model.entries else np.zeros(len(self.model.classes))
        style = [np.log1p(n), len(raw) / max(1, n), len(distinct) / max(1, n), sum(map(eq, words, words[1:])) / max(1, n)]
        return n, np.concatenate([style, np.sqrt(shares), np.log1p(hits), hits > 0])


def posteriors(model: Model, measures: np.ndarray) -> np.ndarray:
    if model.weights is None:
        return np.full((len(measures), len(model.classes)), 1 / len(model.classes))
    x = np.concatenate([(measures - model.centre) / model.scale, np.ones((len(measures), 1))], axis=1)
    z = np.clip(x @ model.weights, -30, 30)
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_softmax(x: np.ndarray, y: np.ndarray, k: int, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Penalised softmax regression by Newton's method; ``x`` ends in a column of ones."""
    n, d = x.shape
    w, keep = np.zeros((d, k)), np.full((d, 1), ridge)
    keep[-1] = 1e-3
    target = np.eye(k)[y]

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x @ w
        z -= z.max(axis=1, keepdims=True)
        total = np.log(np.exp(z).sum(axis=1))
        return (total - (z * target).sum(axis=1)).sum() + (keep * w * w).sum() / 2, np.exp(z - total[:, None])

    loss, p = at(w)
    for _ in range(rounds):
        gradient = (x.T @ (p - target) + keep * w).ravel(order="F")
        hessian = np.zeros((d * k, d * k))
        for a in range(k):
            for b in range(k):
                curve = p[:, a] * ((a == b) - p[:, b])
                hessian[a * d : a * d + d, b * d : b * d + d] = (x * curve[:, None]).T @ x
        hessian += np.diag(np.tile(keep.ravel(), k)) + 1e-6 * np.eye(d * k)
        step = np.linalg.solve(hessian, gradient).reshape(d, k, order="F")
        size = 1.0
        while size > 1e-4:
            next_loss, next_p = at(w - size * step)
            if next_loss <= loss:
                break
            size /= 2
        gained, w, loss, p = loss - next_loss, w - size * step, next_loss, next_p
        if gained < 1e-6 * max(1.0, loss):
            break
    return w


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: Column,
    classes: list[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    max_labelled: int = 12_000,
) -> Model:
    """Fit to ``label`` (an expression over ``labels`` that gives one of ``classes``, or null for rows not to use).

    Of several labels of an id the first by name counts; of several texts of an id all are trained on.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), label.alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(classes))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # of max_labelled rows at most
    rows = stored(texts.join(F.broadcast(chosen), "doc_id").distinct(), "labelled")
    model = Model(classes)
    for i, name in enumerate(classes):
        for trait, _ in telling_traits(rows.withColumn("y", (F.col("label") == name).cast("int"))):
            model.entries.setdefault(trait, i)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Measures(model)
        for batch in small_batches(batches):
            found = [own(t)[1].tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.list_(pa.float64()))], names=["label", "x"])

    found = rows.select("text", "label").mapInArrow(measure, "label string, x array<double>").toArrow()
    if not found.num_rows:
        return model
    x = np.array(found.column("x").to_pylist())
    y = np.array([classes.index(c) for c in found.column("label").to_pylist()])
    model.centre, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    standard = np.concatenate([(x - model.centre) / model.scale, np.ones((len(x), 1))], axis=1)
    model.weights = fit_softmax(standard, y, len(classes))
    return model


def with_posteriors(rows: DataFrame, model: Model, text_col: str = "text", words: str = "n_words", out: str = "posteriors") -> DataFrame:
    """``rows`` with the number of words of each text and the posteriors of the classes, in their order."""
    at = rows.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Measures(model)
        for batch in small_batches(batches):
            seen = [own(t.as_py() or "") for t in batch.column(at)]
            p = posteriors(model, np.array([m for _, m in seen]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([n for n, _ in seen], pa.int64()), pa.array(p.tolist(), pa.list_(pa.float64()))],
                names=[*batch.schema.names, words, out],
            )

    from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

    schema = StructType([*rows.schema.fields]).add(words, LongType()).add(out, ArrayType(DoubleType()))
    return rows.mapInArrow(run, schema)
