"""Connected components of a link table, by repeated star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.shared import dropped, stored


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node that ``links`` mentions with another.

    Each round hangs the larger neighbours of every node, then its smaller ones, on the smallest of them; the links
    left are written to the shared folder, so a lost executor costs at most one round, and those of the round before
    are deleted. The rounds end when no link changes, after about as many as the logarithm of the longest path. Rows
    with a null end and links of a node with itself are ignored; repeated links count once; without links there are
    no rows.
    """
    now = links.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")
    ).distinct()
    now = stored(now, "links")
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        old, now = now, stored(small, "links")
        before, mark = mark, _mark(now)
        dropped(old)
        if mark == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _mark(links: DataFrame) -> tuple:
    """Count and order-free hash of the links."""
    row = links.agg(
        F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    return tuple(row)
