"""Where the sources of a language differ from it and from each other, term by term, with a sketch before the count.

A first pass over the texts makes one count-min sketch of document frequencies, keyed by language and term. Its
counters stop at the least frequency asked for and merge by sums, so a cell never tells less than the frequency of any
of its terms. The second pass counts terms inside each task and drops those whose cells stay below that least
frequency before anything is shuffled; what is left is counted exactly, and the least frequency is applied to exact
counts, so the sketch's chance meetings change no result. Sources are then compared over the terms that occur in them:
a pair's sum over all kept terms is its sum for two absent counts, corrected for the terms of one and of the other (by
their distinct counts) and for the terms of both (a join on the term).

Cases: null text, language or source read as the empty string; repeated rows count as documents of their own; an empty
text has no terms, its source still is a group; a language without kept terms gives its pairs the value 0; ties are
ranked by the item's bytes; texts and terms of any length are read whole; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tideline.llm.shared import small_batches, stored

#: Rows of the sketch, cells of a row, cells of a block. The bits for the second pass take ROWS * CELLS / 8 bytes.
ROWS, CELLS, BLOCK = 2, 1 << 24, 1 << 14
#: Bytes of text hashed at a time; distinct terms, and bytes of text, that a task counts before it passes its counts on.
AT_ONCE, MOST_TERMS, MOST_BYTES = 1 << 20, 400_000, 1 << 26
#: Terms are runs of these bytes of UTF-8 (letters of ASCII, all else beyond ASCII), A to Z lower-cased.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
STEP = 0x9E3779B97F4A7C15
SPREAD = np.uint64(0xBF58476D1CE4E5B9)
MILLIARD = 1_000_000_000


def powers(step: int, n: int) -> np.ndarray:
    return np.cumprod(np.full(n, step, dtype=np.uint64), dtype=np.uint64)


@cache
def known_powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of STEP and of its inverse, for pieces of the usual length."""
    return powers(STEP, 2 * AT_ONCE), powers(pow(STEP, -1, 1 << 64), 2 * AT_ONCE)


def term_hashes(text: bytes, seed: int) -> np.ndarray:
    """A 64-bit hash of each term of ``text`` (made of the bytes of TERM_BYTES), in order: a polynomial of its bytes."""
    data = np.frombuffer(b" " + text + b" ", dtype=np.uint8)
    n = len(data)
    up, down = known_powers() if n <= 2 * AT_ONCE else (powers(STEP, n), powers(pow(STEP, -1, 1 << 64), n))
    edges = np.flatnonzero((data[1:] != 32) != (data[:-1] != 32)) + 1
    starts, ends = edges[::2], edges[1::2]
    sums = np.cumsum(data * up[:n], dtype=np.uint64)
    # the inverse powers bring each term to the same place
    return mixed((sums[ends - 1] - sums[starts - 1]) * down[starts] ^ np.uint64(seed))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * SPREAD
    return (x ^ (x >> np.uint64(32))) * np.uint64(STEP)


def cells_of(hashes: np.ndarray, row: int, cells: int) -> np.ndarray:
    """The cell of each hash in a row of the sketch."""
    return (mixed(hashes + np.uint64(row * STEP % (1 << 64))) & np.uint64(cells - 1)).astype(np.int64)


def pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about AT_ONCE bytes, cut between terms."""
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= AT_ONCE else text.find(b" ", at + AT_ONCE)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def document_hashes(text: bytes, seed: int) -> np.ndarray:
    """Hashes of the distinct terms of one document."""
    found = [np.unique(term_hashes(p, seed)) for p in pieces(text)]
    return np.unique(np.concatenate(found)) if len(found) > 1 else found[0] if found else np.empty(0, dtype=np.uint64)


def sketch(rows: DataFrame, least: int, cells: int = CELLS) -> DataFrame:
    """``row, block, cells``: the cells (offsets in the block, as little-endian 16-bit integers) that reach ``least`` documents.

    ``rows`` has ``lang, text`` in binary. A task passes on each cell it touched as often as counted, ``least`` times at
    most; the merge holds the counters of the blocks dealt to its task, at most ROWS * ``cells`` bytes.
    """
    block_cells = min(BLOCK, cells)

    def touch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((ROWS, cells), dtype=np.uint8)
        waiting, size = [], 0

        def add() -> None:
            hashes = np.concatenate(waiting)
            for row in range(ROWS):
                at, n = np.unique(cells_of(hashes, row, cells), return_counts=True)
                counts[row, at] = np.minimum(counts[row, at] + np.minimum(n, least), least)

        for batch in small_batches(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                waiting.append(document_hashes(text.as_py().translate(TERM_BYTES), xxh64_intdigest(lang)))
                size += len(waiting[-1])
                if size > AT_ONCE:
                    add()
                    waiting, size = [], 0
        if waiting:
            add()
        for row in range(ROWS):
            found = np.flatnonzero(counts[row])
            found = np.repeat(found, counts[row, found])
            blocks, starts = np.unique(found // block_cells, return_index=True)
            parts = np.split((found % block_cells).astype("<u2"), starts[1:]) if len(blocks) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(blocks), row, dtype=np.int32)), pa.array(blocks.astype(np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())],
                names=["row", "block", "cells"],
            )

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row, block, touched in zip(*(c.to_pylist() for c in batch.columns)):
                n = np.bincount(np.frombuffer(touched, dtype="<u2"), minlength=block_cells)
                at = held.setdefault((row, block), np.zeros(block_cells, dtype=np.uint8))
                np.minimum(at + np.minimum(n, least), least, out=at, casting="unsafe")
        for (row, block), n in held.items():
            full = np.flatnonzero(n >= least).astype("<u2").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([block], pa.int32()), pa.array([full], pa.binary())], names=["row", "block", "cells"])

    touched = rows.mapInArrow(touch, "row int, block int, cells binary")
    return touched.repartition("row", "block").mapInArrow(merge, "row int, block int, cells binary")


def full_cells(found: DataFrame, cells: int = CELLS) -> np.ndarray:
    """The sketch as bits, a row of ``cells`` / 8 bytes each: of fixed size, whatever the table."""
    bits, block_cells = np.zeros((ROWS, cells // 8), dtype=np.uint8), min(BLOCK, cells)
    for row, block, full in found.toLocalIterator():
        own = np.zeros(block_cells, dtype=np.uint8)
        own[np.frombuffer(full, dtype="<u2")] = 1
        bits[row, block * block_cells // 8 : (block + 1) * block_cells // 8] = np.packbits(own, bitorder="little")
    return bits


def possible(terms: list[bytes], seed: int, bits: np.ndarray) -> np.ndarray:
    """Which of the terms may reach the least frequency."""
    hashes, out = np.concatenate([term_hashes(b" ".join(terms[at : at + 65536]), seed) for at in range(0, len(terms), 65536)]), True
    for row in range(ROWS):
        cells = cells_of(hashes, row, 8 * bits.shape[1])
        out = out & (bits[row, cells >> 3] >> (cells & 7).astype(np.uint8) & 1).astype(bool)
    return out


def counted(rows: DataFrame, bits: np.ndarray, most_terms: int = MOST_TERMS) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of the terms that the sketch leaves, summed inside tasks only."""
    known = rows.sparkSession.sparkContext.broadcast(bits.tobytes())  # ROWS * cells / 8 bytes

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(known.value, dtype=np.uint8).reshape(ROWS, -1)
        groups: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
        size = read = 0
        for batch in small_batches(batches):
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text")):
                words = text.as_py().translate(TERM_BYTES).split()
                n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                before, read = len(n), read + len(text.as_py())
                n.update(words)
                docs.update(set(words))
                size += len(n) - before
                if size > most_terms or read > MOST_BYTES:
                    yield from told(groups, bits)
                    groups, size, read = {}, 0, 0
        yield from told(groups, bits)

    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def told(groups: dict[tuple[bytes, bytes], tuple[Counter, Counter]], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in groups.items():
        if not n:
            continue
        terms = list(n)
        left = pa.array(possible(terms, xxh64_intdigest(lang), bits))
        texts = lambda x: pa.array([x], pa.binary()).cast(pa.string())
        term = pa.array(terms, pa.binary()).filter(left).cast(pa.string())
        same = np.zeros(len(term), dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                texts(lang).take(pa.array(same)), texts(source).take(pa.array(same)), term,
                pa.array(list(n.values()), pa.int64()).filter(left), pa.array([docs[t] for t in terms], pa.int64()).filter(left),
            ],
            names=["lang", "source", "term", "n", "docs"],
        )


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 * (n + 1) / (total + terms)), exact."""
    above = F.lit(MILLIARD).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)")
    return F.lit(1) + _div(above, (total + terms).cast("decimal(19,0)"))


def _div(a: Column, b: Column) -> Column:
    """Quotient without its fraction; null where ``b`` is 0."""
    return F.call_function("div", a, F.when(b != 0, b))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / q); sums of it over terms stay within 64 bits, for shares sum to 10**9 and one for each term."""
    return _div((p - q) * (p - q), q)


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 3, top: int = 200, cells: int = CELLS, most_terms: int = MOST_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: how each source of a language differs from the others and from the language.

    Part ``pair``: every other source of the language with the divergence summed over all kept terms; part ``term``: the
    ``top`` terms that the source uses more than its language. Terms are kept from ``least`` documents of the language on.
    ``cells`` (a power of two) is the width of the sketch: with far more distinct terms it discards less.
    """
    text, lang, source = (F.coalesce(docs[c], F.lit("")) for c in (text_col, lang_col, source_col))
    rows = docs.select(lang.cast("binary").alias("lang"), source.cast("binary").alias("source"), text.cast("binary").alias("text"))
    bits = full_cells(sketch(rows.select("lang", "text"), least, cells), cells)
    sums = counted(rows, bits, most_terms).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # one row a term, with at most as many entries as its language has sources
    terms = sums.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("of_lang"), F.collect_list(F.struct("source", "n")).alias("sources")
    )
    terms = stored(terms.where(F.col("docs") >= least).select(F.monotonically_increasing_id().alias("tid"), "lang", "term", "of_lang", "sources"), "terms")

    uses = terms.select("tid", "lang", "term", "of_lang", F.inline("sources"))
    totals = uses.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("of_lang").alias("lang_total"))
    groups = docs.select(lang.alias("lang"), source.alias("source")).distinct().join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = groups.fillna(0, ["total", "terms", "lang_total"])
    groups = stored(groups.select(F.monotonically_increasing_id().alias("gid"), "*", share(F.lit(0), F.col("total"), F.col("terms")).alias("none")), "groups")

    shares = uses.join(groups, ["lang", "source"]).select(
        "tid", "gid", "term", "none", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("of_lang"), F.col("lang_total"), F.col("terms")).alias("q")
    )
    shares = stored(shares, "shares")
    ranked = Window.partitionBy("gid").orderBy(F.desc("value"), "item")
    more = shares.where("p > q").select("gid", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    more = more.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    pairs = pair_sums(shares, groups).withColumn("rank", F.row_number().over(ranked))
    return more.unionByName(pairs).join(groups.select("gid", "lang", "source"), "gid").select("lang", "source", "part", "item", "value", "rank")


def pair_sums(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """``gid, part, item, value``: for each two sources of a language the divergence of the first from the second, over all kept terms."""
    x = groups.select("lang", F.col("gid").alias("gid"), "terms", F.col("none").alias("x0"))
    y = groups.select("lang", F.col("gid").alias("other"), F.col("source").alias("item"), F.col("none").alias("y0"))
    every = x.join(y, "lang").where("gid != other")
    # terms of one, by its distinct shares: both as the first and as the second of the pair
    levels = shares.groupBy("gid", "p").count()
    seen = every.join(levels, "gid").groupBy("gid", "other").agg(
        F.sum(F.col("count") * (gap(F.col("p"), F.col("y0")) - gap(F.col("x0"), F.col("y0")))).alias("first"),
        F.sum(F.col("count") * (gap(F.col("y0"), F.col("p")) - gap(F.col("y0"), F.col("x0")))).alias("second"),
    )
    one = seen.select("gid", "other", F.col("first").alias("v")).union(seen.select("other", "gid", "second"))
    # terms of both, each two sources once
    a = shares.select("tid", F.col("gid").alias("a"), F.col("p").alias("pa"), F.col("none").alias("a0"))
    b = shares.select("tid", F.col("gid").alias("b"), F.col("p").alias("pb"), F.col("none").alias("b0"))
    pa_, pb, a0, b0 = (F.col(c) for c in ("pa", "pb", "a0", "b0"))
    met = a.join(b, "tid").where("a < b").groupBy("a", "b").agg(
        F.sum(gap(pa_, pb) - gap(pa_, b0) - gap(a0, pb) + gap(a0, b0)).alias("ab"), F.sum(gap(pb, pa_) - gap(pb, a0) - gap(b0, pa_) + gap(b0, a0)).alias("ba")
    )
    both = met.select(F.col("a").alias("gid"), F.col("b").alias("other"), F.col("ab").alias("v")).union(met.select("b", "a", "ba"))
    sums = one.union(both).groupBy("gid", "other").agg(F.sum("v").alias("v"))
    base = F.when(F.col("terms") > 0, F.col("terms") * gap(F.col("x0"), F.col("y0"))).otherwise(0)
    return every.join(sums, ["gid", "other"], "left").select("gid", F.lit("pair").alias("part"), "item", (base + F.coalesce("v", F.lit(0))).alias("value"))
