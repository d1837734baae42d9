"""Exact token counts at every prefix of a text, for a sentencepiece BPE model with byte fallback.

A prefix's encoding is the encoding of a shorter prefix and one last token: the only one of the tokens that end
there which stays apart from its predecessor when both are encoded together. So one pass over a text gives, for
each position, the last token and the count (prefix dynamic programming), and truncation and budget questions are
answered from the stored counts without encoding again. No piece of such a model holds a space after another
character, so the passes over runs of spaces with the word behind them are independent, as
are lines; each worker keeps the passes of words it has met.

Cases: a null text counts as an empty one (no tokens); rows with a null or repeated id are counted like others;
texts of any length are read whole, one at a time; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.shared import Kept, new_path, small_batches

SPACE = "▁"
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Longer words are passed over again each time; bytes of words, and number of pairs of pieces and of steps from one
#: ending to the next, that a worker keeps.
KEPT_LENGTH, KEPT_BYTES, KEPT_PAIRS = 48, 128 << 20, 300_000


class Ending(dict):
    """What a text ends in, as far as pieces begin like it; maps the next character to the ending with it.

    ``tokens`` are those that end there, longest first and the last character at any rate: length, token, number of
    tokens it is written as, and whether it stays apart from those met before it.
    """

    __slots__ = ("tail", "tokens", "counter")

    def __init__(self, counter: PrefixCounter, tail: str, char: str):
        super().__init__()
        self.counter, self.tail = counter, tail
        found = [tail[i:] for i in range(len(tail) - 1) if tail[i:] in counter.rank]
        # a character without a piece is written as its bytes
        found += [char] if char else []
        self.tokens = [(len(t), t, 1 if t in counter.rank else len(t.encode()), counter.apart.setdefault(t, {})) for t in found]

    def __missing__(self, char: str) -> Ending:
        found = self[char] = self.counter.ending(self.tail + char)
        return found


class PrefixCounter(Kept):
    """Maps a word with one space before it, or behind a line end as ``\\n`` and the word, to the change of the token count at each code point, as signed bytes."""

    def __init__(self, model_path: str):
        import sentencepiece

        super().__init__(KEPT_BYTES)
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = model.get_piece_size()
        self.rank = {
            model.id_to_piece(i): -model.get_score(i)
            for i in range(n)
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        }
        if any(SPACE in piece.lstrip(SPACE) for piece in self.rank):
            raise ValueError("a piece holds a space behind another character: words can't be counted apart")
        if any("\n" in piece for piece in self.rank):
            raise ValueError("a piece holds a line end: lines can't be counted apart")
        self.beginnings = {piece[:n] for piece in self.rank for n in range(1, len(piece) + 1)}
        self.forget()

    def forget(self) -> None:
        """Drop the endings and pairs met so far."""
        self.kept, self.endings, self.apart = 0, {}, {}
        self.start = Ending(self, "", "")

    def ending(self, text: str) -> Ending:
        self.kept += 1
        if self.kept >= KEPT_PAIRS:
            self.forget()
        tail = text
        while tail and tail not in self.beginnings:
            tail = tail[1:]
        known = tail or text[-1]
        if known not in self.endings:
            self.endings[known] = Ending(self, tail, text[-1])
        return self.endings[known]

    def merged(self, text: str) -> list[str]:
        """The pieces of ``text``: of all neighbours that form a piece the best ranked, leftmost pair is joined, again and again."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.rank.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stays(self, last: str, token: str) -> bool:
        """Whether the two stay apart when encoded together (and, without ``last``, whether the token is one piece)."""
        self.kept += 1
        return self.merged(last + token) == ([last, token] if last else [token])

    def counts(self, word: str) -> list[int]:
        """Token counts of the prefixes of 0, 1, 2, ... code points."""
        ending, last, count = self.start, [""], [0]
        for char in word:
            ending = ending[char]
            for length, token, written, apart in ending.tokens:
                before = last[-length]
                if (known := apart.get(before)) is None:
                    known = apart[before] = self.stays(before, token)
                if known:
                    last.append(token)
                    count.append(count[-length] + written)
                    break
            else:
                raise AssertionError(f"no last token for {word[: len(last)]!r}")
        return count

    def word_steps(self, word: str) -> bytes:
        count = self.counts(word)
        return bytes([(b - a) & 255 for a, b in zip(count, count[1:])])

    def make(self, word: str) -> bytes:
        return self.word_steps(word[1:] if word[:1] == "\n" else SPACE + word)

    def keep(self, word: str, steps: bytes) -> None:
        if len(word) <= KEPT_LENGTH:
            super().keep(word, steps)

    def steps(self, text: str) -> np.ndarray:
        """The change of the token count at each code point of ``text``; their running sum is the prefix table."""
        if not text:
            return np.zeros(0, dtype=np.int8)
        lines = []
        for i, line in enumerate(text.split("\n")):
            if i == 0:
                line = " " + line  # which the model puts before the text
            if "  " in line or SPACE in line or line.endswith(" "):
                lines.append(b"".join(map(self.word_steps, WORD.findall(line.replace(" ", SPACE)))))
            else:
                first, *words = line.split(" ")
                lines.append((self["\n" + first] if first else b"") + b"".join(map(self.__getitem__, words)))
        steps = np.frombuffer(b"\x01".join(lines), dtype=np.int8)  # a line end is one byte, one token
        # the space put before the text belongs to its first code point
        joined = steps[1:].copy()
        joined[0] += steps[0]
        return joined


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(model_path: str) -> PrefixCounter:
    """One counter for each model in a worker process."""
    if model_path not in _COUNTERS:
        _COUNTERS[model_path] = PrefixCounter(model_path)
    return _COUNTERS[model_path]


TABLE = "doc_id long, n_bytes long, n_tokens long, prefix_steps binary"


def prefix_token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, prefix_steps`` for each row.

    ``prefix_steps`` holds the table of counts at every code point (compressed steps, see ``prefix_table``).
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, squeeze = counter(model_path), zstandard.ZstdCompressor(level=1)
        for batch in small_batches(batches):
            totals, stored = [], []
            for text in batch.column("text"):
                steps = table.steps(text.as_py() or "")
                totals.append(int(steps.sum(dtype=np.int64)))
                stored.append(squeeze.compress(steps.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(totals, pa.int64()), pa.array(stored, pa.binary())],
                names=["doc_id", "n_bytes", "n_tokens", "prefix_steps"],
            )

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")
    )
    return rows.mapInArrow(run, TABLE)


def prefix_table(prefix_steps: bytes) -> np.ndarray:
    """Token counts of the prefixes of 1, 2, ... code points."""
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(prefix_steps), dtype=np.int8), dtype=np.int64)


def chars_within(table: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix with at most ``budget`` tokens; a longer prefix may have fewer tokens than a shorter one."""
    fits = np.flatnonzero(table <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def _answer(fn, prefix_steps: Column, asked: Column) -> Column:
    def run(steps, asked):
        return asked.__class__([fn(prefix_table(s), a) if s is not None and a is not None else None for s, a in zip(steps, asked)])

    def typed(steps: "pd.Series", asked: "pd.Series") -> "pd.Series":  # noqa: F821
        return run(steps, asked)

    import pandas as pd

    typed.__annotations__ = {"steps": pd.Series, "asked": pd.Series, "return": pd.Series}
    return F.pandas_udf(typed, "long")(prefix_steps, asked.cast("long"))


def tokens_in_prefix(prefix_steps: Column, n_chars: Column) -> Column:
    """Token count of the first ``n_chars`` code points (of all, where there are fewer)."""
    return _answer(lambda t, n: int(t[min(n, len(t)) - 1]) if n > 0 and len(t) else 0, prefix_steps, n_chars)


def chars_in_budget(prefix_steps: Column, budget: Column) -> Column:
    """Code points of the longest prefix whose token count is at most ``budget``."""

    return _answer(chars_within, prefix_steps, budget)


def count_report(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, chars_within`` of each row of ``docs``, from the prefix tables in the shared folder.

    ``chars_within`` is how many code points a text cut to ``limit`` tokens keeps.
    """
    spark = docs.sparkSession
    path = new_path(spark, "prefix-counts", keep=True)
    prefix_token_counts(docs, model_path).write.parquet(path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 64):
            tokens, chars = [], []
            for steps in batch.column("prefix_steps"):
                table = prefix_table(steps.as_py())
                tokens.append(int(table[-1]) if len(table) else 0)
                chars.append(chars_within(table, limit))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(tokens, pa.int64()), pa.array(chars, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "chars_within"],
            )

    kept = spark.read.schema(TABLE).parquet(path).select("doc_id", "n_bytes", "prefix_steps")
    answers = kept.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, chars_within long")
    return answers.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "chars_within")
