"""Merkle manifest of a table: a tree of digests for each group of rows, a tree over the groups, a proof for each row.

Leaves are numbered within their group over sorted ranges of rows: each range counts its rows, and sums over the ranges
before tell where it starts. Then superblocks are reduced: indices are bucketed by fanout ** levels, each bucket is
collapsed by that many levels in one call, its roots are the nodes of the next round, and a row's proof is the lower
part of its bucket followed by the upper part of its bucket's root. The number of rounds is the logarithm of the
largest group to the base of the bucket size.

Cases: null fields are hashed as ``-``, so they differ from empty ones; a null group is a group of its own, before all
others, and null ids come first; rows of one id are ordered by their leaf, repeated rows are leaves of their own with
equal digests; a group of one row has its leaf as root; an empty table gives no rows; texts of any length are hashed
whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tideline.llm.shared import stored

#: Children of a node; levels collapsed in one call: buckets have FANOUT ** LEVELS nodes.
FANOUT, LEVELS = 2, 8
#: The columns of a row that its leaf covers.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(*fields: Column) -> Column:
    """Digest of the fields in order, each with its length, so that no two rows share an input."""
    told = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*told), 256)


def folded(start: Column, before: Column, after: Column) -> Column:
    """The root that a leaf and its siblings give, level by level."""
    levels = F.arrays_zip(before.alias("before"), after.alias("after"))
    return F.aggregate(levels, start, lambda node, at: F.sha2(F.concat(at["before"], node, at["after"]), 256))


def height(n: int, fanout: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    steps = 0
    while n > 1:
        n, steps = -(-n // fanout), steps + 1
    return steps


def collapse(nodes: list[str], steps: int, fanout: int) -> tuple[list[list[str]], list[list[str]], str]:
    """Of each node its siblings to the left and to the right for ``steps`` levels (joined), and the root over them."""
    before, after, level, width = [[] for _ in nodes], [[] for _ in nodes], nodes, 1
    for _ in range(steps):
        runs = [level[at : at + fanout] for at in range(0, len(level), fanout)]
        left = ["".join(run[:k]) for run in runs for k in range(len(run))]
        right = ["".join(run[k + 1 :]) for run in runs for k in range(len(run))]
        for i in range(len(nodes)):
            before[i].append(left[i // width])
            after[i].append(right[i // width])
        level, width = [hashlib.sha256("".join(run).encode()).hexdigest() for run in runs], width * fanout
    return before, after, level[0]


def null_safe(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on equal or both null ``on``; the columns of ``right`` besides those follow."""
    right = right.withColumnsRenamed({c: f"_{c}" for c in on})
    same = reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[f"_{c}"]) for c in on])
    return left.join(right, same).drop(*[f"_{c}" for c in on])


def numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, their place from 0 within ``by`` in ``order`` (rows alike in all of it in any order), and ``n``, the rows there.

    ``rows`` should be a stored table with enough in ``order`` to tell most rows apart: ranges are cut between unequal ones.
    """
    at = F.monotonically_increasing_id()
    ranged = stored(rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_at", at), "ranges")
    ranged = ranged.withColumn("_range", F.call_function("shiftright", "_at", F.lit(33)))
    # one row for each range and group
    ranges = ranged.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    over = Window.partitionBy(*by)
    before = over.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(*by, "_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(over).alias("n"))
    placed = null_safe(ranged, starts, [*by, "_range"])
    return placed.withColumn("idx", F.col("_start") + F.col("_at") - F.col("_first")).drop("_at", "_range", "_first", "_start")


def reduced(nodes: DataFrame, by: list[str], carried: list[str], fanout: int, levels: int) -> DataFrame:
    """``by``, ``carried`` (strings), ``before``, ``after`` (siblings by level) and ``top`` (root of ``by``) for ``nodes`` with ``idx, n, node``."""
    span = fanout**levels
    texts = ArrayType(StringType())
    schema = StructType(
        [nodes.schema[c] for c in by]
        + [StructField(c, LongType()) for c in ("bucket", "idx", "n")]
        + [StructField(c, StringType()) for c in (*carried, "top")]
        + [StructField("before", texts), StructField("after", texts)]
    )

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx", ignore_index=True)
        before, after, top = collapse(rows["node"].tolist(), min(levels, height(int(rows["n"].iloc[0]), fanout)), fanout)
        return rows.drop(columns="node").assign(top=top, before=pd.Series(before), after=pd.Series(after))[schema.names]

    bucketed = nodes.select(*by, F.floor(F.col("idx") / span).alias("bucket"), "idx", "n", "node", *carried)
    lower = stored(bucketed.groupBy(*by, "bucket").applyInPandas(run, schema), "superblocks")
    most = lower.agg(F.max("n")).first()[0] or 0
    if most <= span:
        return lower.select(*by, *carried, "before", "after", "top")
    roots = lower.where(F.col("idx") % span == 0).select(
        *by, F.col("bucket").alias("idx"), F.ceil(F.col("n") / span).alias("n"), F.col("top").alias("node"), F.col("bucket").cast("string").alias("key")
    )
    upper = reduced(roots, by, ["key"], fanout, levels)
    upper = upper.select(*by, F.col("key").cast("long").alias("bucket"), F.col("before").alias("_b"), F.col("after").alias("_a"), F.col("top").alias("_top"))
    return null_safe(lower, upper, [*by, "bucket"]).select(
        *by, *carried, F.concat("before", "_b").alias("before"), F.concat("after", "_a").alias("after"), F.col("_top").alias("top")
    )


def manifest(leaves: DataFrame, group: str, order: list[str], carried: list[str], fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """``group``, ``carried``, ``leaf, subroot, root, before, after`` for each row of ``leaves`` (group, order, carried, leaf).

    ``carried`` are columns of strings. Leaves are ordered by ``order`` within their group, groups by their bytes.
    """
    slim = stored(leaves.withColumn("_tie", F.rand(13)), "leaves")
    placed = numbered(slim, [group], [*order, "leaf", "_tie"]).withColumn("node", F.col("leaf"))
    trees = stored(reduced(placed, [group], ["leaf", *carried], fanout, levels).withColumnRenamed("top", "subroot"), "trees")
    roots = stored(trees.groupBy(group).agg(F.first("subroot").alias("node")).select(group, "node", F.lit(0).alias("_all")), "subroots")
    upper = reduced(numbered(roots, ["_all"], [group]).withColumn("key", F.col(group)), ["_all"], ["key"], fanout, levels)
    upper = upper.select(F.col("key").alias(group), F.col("before").alias("_b"), F.col("after").alias("_a"), F.col("top").alias("root"))
    return null_safe(trees, upper, [group]).select(
        group, *carried, "leaf", "subroot", "root", F.concat("before", "_b").alias("before"), F.concat("after", "_a").alias("after")
    )


def dataset_manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang") -> DataFrame:
    """The manifest of a table: ``id_col, group_col, leaf, subroot, root, before, after``, to store beside it."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(group_col).cast("string").alias(group_col), F.col(id_col).cast("string").alias("_key"), leaf_hash(*[F.col(f) for f in fields]).alias("leaf"))
    made = manifest(rows, group_col, ["_id"], ["_key"])
    kind = docs.schema[id_col].dataType
    return made.select(F.col("_key").cast(kind).alias(id_col), group_col, "leaf", "subroot", "root", "before", "after")


def broken(docs: DataFrame, stored_manifest: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id") -> DataFrame:
    """``id_col, leaf, found``: rows of a table or of its manifest that don't prove their place under the root (null: missing)."""
    now = docs.select(F.col(id_col).alias("_id"), leaf_hash(*[F.col(f) for f in fields]).alias("found")).distinct()
    then = stored_manifest.select(id_col, "leaf", "root", "before", "after")
    met = then.join(now, then[id_col].eqNullSafe(now["_id"]) & (F.col("leaf") == F.col("found")), "full")
    holds = F.coalesce(folded(F.col("found"), F.col("before"), F.col("after")) == F.col("root"), F.lit(False))
    return met.where(~holds).select(F.coalesce(id_col, "_id").alias(id_col), "leaf", "found")


def tamper_report(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``: the manifest of ``docs``, proved against rows tampered with.

    Where 7 divides the checksum of a doc_id its n_chars is one more than the manifest knows; such rows don't verify.
    """
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    fields = [F.col(f) for f in FIELDS]
    other = [F.col(f) + 1 if f == "n_chars" else F.col(f) for f in FIELDS]
    leaf = leaf_hash(*fields)
    rows = docs.select("lang", F.col("doc_id").alias("_id"), F.col("doc_id").cast("string").alias("key"), leaf.alias("leaf"), F.when(changed, leaf_hash(*other)).otherwise(leaf).alias("now"))
    made = manifest(rows, "lang", ["_id"], ["key", "now"], fanout, levels)
    fold = folded(F.col("now"), F.col("before"), F.col("after"))
    siblings = F.array_join(F.zip_with("before", "after", lambda b, a: F.concat(b, a)), "")
    return made.select(
        F.col("key").cast("long").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), fold.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
