"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed is a fixed mask over consecutive words; words under its zeros are ignored, so a replaced word there does not
hide the match. Seeds of all benchmark items are joined with the seeds at every position of every document; around
each diagonal that is hit, document and item are compared word by word. An item of up to ``window`` words counts as
contained where at least ``overlap`` of its words stand in their places; a longer one where that holds for some
stretch of ``window`` words.

No such place is lost: an item takes the masks of the first of FAMILIES that shows a seed however the replaced words
fall (``least_to_hide``, worked out on the driver for each length in words); an item in which no word may differ is
its own mask. Documents take the masks that some item has.

Cases: words are runs of letters, marks and digits in lower case; null and empty texts match nothing; an item of one
word matches each document that has it; ids may be null or repeated (a finding names the id; ``clean`` goes by id and
text together); texts of any length are read whole; empty tables give no findings; extra columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Masks to choose from, those of more words first.
FAMILIES = (("11111", "110111"), ("1111", "11011"), ("1111", "11011", "10111", "11101"), ("111", "1011", "1101"), ("11", "101"), ("1",))
#: Seeds of the benchmark that are broadcast at once; a larger benchmark takes several passes.
SEEDS_AT_ONCE = 500_000


@lru_cache(maxsize=None)
def least_to_hide(masks: tuple[str, ...], n: int) -> int:
    """The fewest of ``n`` words that must differ so that no mask shows at any place among them."""
    ones, span = [(len(m), int(m, 2)) for m in masks], max(map(len, masks))
    best = {0: 0}  # by which of the last span - 1 words are equal
    for at in range(n):
        after: dict[int, int] = {}
        for state, differ in best.items():
            for equal in (0, 1):
                now = state << 1 | equal
                if equal and any(at + 1 >= size and now & mask == mask for size, mask in ones):
                    continue
                key, differing = now & ((1 << (span - 1)) - 1), differ + 1 - equal
                after[key] = min(after.get(key, n + 1), differing)
        best = after
    return min(best.values())


def masks_for(n: int, overlap: float) -> tuple[str, ...]:
    """The masks of an item of which ``n`` words are compared."""
    may_differ = n - math.ceil(overlap * n - 1e-9)
    if not may_differ and n <= len(FAMILIES[0][0]):
        return ("1" * n,)
    return next((masks for masks in FAMILIES if least_to_hide(masks, n) > may_differ), FAMILIES[-1])


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(hashes: Column, at: Column, masks: tuple[str, ...]) -> Column:
    """The seeds that start at a position, one for each mask; those that would run past the end are null."""
    found = []
    for mask in masks:
        under = [F.get(hashes, at + i) for i, bit in enumerate(mask) if bit == "1"]
        found.append(F.when(under[-1].isNotNull(), F.xxhash64(F.lit(mask), *under)))
    return F.array(*found)


def _at_positions(rows: DataFrame, keep: list[str], masks: tuple[str, ...]) -> DataFrame:
    """A row for each position and mask of ``hashes``: the columns ``keep``, ``at`` and ``seed``."""
    shortest = min(map(len, masks))
    enough = rows.where(F.size("hashes") >= shortest)
    at = F.explode(F.sequence(F.lit(0), F.size("hashes") - shortest)).alias("at")
    placed = enough.select(*keep, "hashes", at)
    seeded = placed.select(*keep, "hashes", "at", F.explode(_seeds(F.col("hashes"), F.col("at"), masks)).alias("seed"))
    return seeded.where(F.col("seed").isNotNull())


def findings(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 50,
    overlap: float = 0.8,
) -> DataFrame:
    """``doc_id, text_hash, item_id, at_word, words, matched, overlap``: the best place of each item that a document contains."""
    hashed = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), word_hashes(F.col(text_col)).alias("hashes")
    )
    items = benchmark.select(F.col(item_col).alias("item_id"), word_hashes(F.col(item_text_col)).alias("hashes")).distinct()
    items = items.where(F.size("hashes") > 0).withColumn("item_key", F.xxhash64("item_id", F.to_json("hashes")))
    # as many rows as there are lengths up to the window
    lengths = items.groupBy(F.least(F.size("hashes"), F.lit(window)).alias("n")).agg(F.sum(F.size("hashes")).alias("words")).collect()
    by_masks: dict[tuple[str, ...], list[int]] = {}
    for row in lengths:
        by_masks.setdefault(masks_for(row.n, overlap), []).append(row.n)
    n_seeds = sum(row.words * len(masks_for(row.n, overlap)) for row in lengths)
    passes = max(1, -(-n_seeds // SEEDS_AT_ONCE))
    parts = [items.where(F.pmod("item_key", F.lit(passes)) == k) for k in range(passes)]
    found = reduce(DataFrame.union, [_pass(hashed, part, by_masks, window, overlap) for part in parts])
    best = F.max(F.struct("overlap", "matched", -F.col("at_word"), "words"))
    return found.groupBy("doc_id", "text_hash", "item_id").agg(best.alias("best")).select(
        "doc_id",
        "text_hash",
        "item_id",
        (-F.col("best.col3")).alias("at_word"),
        F.col("best.words"),
        F.col("best.matched"),
        F.col("best.overlap"),
    )


def _pass(hashed: DataFrame, items: DataFrame, by_masks: dict[tuple[str, ...], list[int]], window: int, overlap: float) -> DataFrame:
    items, none = items.withColumn("n", F.size("hashes")), items.where("false").withColumn("n", F.lit(0))
    own = [(items.where(F.least("n", F.lit(window)).isin(lengths)), masks) for masks, lengths in by_masks.items()] or [(none, FAMILIES[0])]
    seeds = reduce(DataFrame.union, [_at_positions(rows, ["item_key", "n"], masks) for rows, masks in own]).select(
        "seed", "item_key", "n", F.col("at").alias("item_at")
    )
    every = tuple(sorted({mask for _, masks in own for mask in masks}))
    # of SEEDS_AT_ONCE rows at most
    met = _at_positions(hashed, ["doc_id", "text_hash"], every).join(F.broadcast(seeds), "seed")
    start = F.col("at") - F.col("item_at")
    skipped = F.greatest(-start, F.lit(0))
    placed = met.select(
        "doc_id",
        "text_hash",
        "item_key",
        start.alias("start"),
        F.slice("hashes", F.greatest(start, F.lit(0)) + 1, F.col("n") - skipped).alias("beside"),
    )
    lines = placed.groupBy("doc_id", "text_hash", "item_key", "start").agg(F.first("beside").alias("beside"))
    sides = lines.join(
        F.broadcast(items.select("item_key", "item_id", F.col("hashes").alias("item"), "n")), "item_key"
    ).withColumn("skipped", F.greatest(-F.col("start"), F.lit(0)))
    same = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda i: F.when(
            (i >= F.col("skipped")) & (F.get(F.col("beside"), i - F.col("skipped")) == F.get(F.col("item"), i)), 1
        ).otherwise(0),
    )
    width = F.least(F.col("n"), F.lit(window))
    compared = sides.withColumn("same", same).withColumn("width", width)
    counted = compared.withColumn(
        "best",
        F.array_max(
            F.transform(
                F.sequence(F.lit(0), F.col("n") - F.col("width")),
                lambda i: F.struct(
                    F.aggregate(F.slice("same", i + 1, F.col("width")), F.lit(0), lambda total, x: total + x).alias("matched"),
                    (-i).alias("behind"),
                ),
            )
        ),
    )
    return counted.select(
        "doc_id",
        "text_hash",
        "item_id",
        (F.col("start") - F.col("best.behind")).alias("at_word"),
        F.col("width").alias("words"),
        F.col("best.matched").alias("matched"),
        (F.col("best.matched") / F.col("width")).alias("overlap"),
    ).where(F.col("overlap") >= overlap)


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The findings without the text's hash."""
    return findings(docs, benchmark, **options).drop("text_hash")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns."""
    found = findings(docs, benchmark, id_col=id_col, text_col=text_col, **options)
    bad = found.select("doc_id", "text_hash").distinct().alias("bad")
    rows = docs.alias("rows")
    same = F.col(f"rows.{id_col}").eqNullSafe(F.col("bad.doc_id")) & (F.xxhash64(f"rows.{text_col}") == F.col("bad.text_hash"))
    return rows.join(bad, same, "left_anti")
