"""Windowed aggregates on streams, and their sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.daily import health_measures
from tideline.operators.registry import latest_row, upsert


def dwell_stream(fixes: DataFrame, slow: Column, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Distinct slow vessels by tumbling window and region.

    Distinct counts aren't allowed on streams, so vessels are made unique within their window first.
    """
    once = (
        fixes.where(slow)
        .withWatermark("msg_time", late)
        .withColumn("w", F.window("msg_time", width))
        .dropDuplicates(["mmsi", "region", "w"])
    )
    return once.groupBy("w", "region").agg(F.count(F.lit(1)).alias("slow_count")).select(
        F.col("w.start").alias("window_start"), "region", "slow_count"
    )


def health_stream(fixes: DataFrame, width_s: int = 600, late: str = "10 minutes", bucket_s: int = 60) -> DataFrame:
    """By window: messages, tanker share, share of the downsampling buckets without a message, share of implausible fixes (``spoof``)."""
    return fixes.withWatermark("msg_time", late).groupBy(F.window("msg_time", f"{width_s} seconds").alias("w")).agg(*health_measures(width_s, bucket_s, "msg_time")).select(
        F.col("w.start").alias("window_start"), "messages", "tanker_share", "gap_ratio", "spoof_share"
    )


def upsert_sink(path: str, keys: list[str], order: str | None = None, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: merge each batch into a keyed table, of which only the buckets it touches are written anew, in one job.

    Of equal keys the row with the last ``order`` stays, whichever batch brought it; without ``order`` the batch's. Keys
    are dealt to ``buckets`` by their hash. A batch's buckets go to a folder of its own, ``path/<batch>/_b=<bucket>``;
    of each bucket the newest folder of a batch that was written to its end counts (``read_upserted``), the one before
    it stays for readers that are still at it, older ones go. A batch that is written again writes the same.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        # at most as many as there are buckets
        touched = sorted(r[0] for r in rows.select("_b").distinct().collect())
        versions = _versions(spark, path, number - 1)
        held = [f"{path}/{versions[b][-1]}/_b={b}" for b in touched if b in versions]
        if held:
            old = spark.read.parquet(*held).withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
            rows_now = old.unionByName(rows, allowMissingColumns=True) if order else upsert(old, rows, keys)
        else:
            rows_now = rows
        fresh = latest_row(rows_now, keys, [order]) if order else rows_now
        fresh.repartition("_b").write.mode("overwrite").partitionBy("_b").parquet(f"{path}/{number}")
        for b in touched:
            for gone in versions.get(b, [])[:-1]:
                _files(spark, path)[0].delete(_files(spark, f"{path}/{gone}/_b={b}")[1], True)
        rows.unpersist()

    return write


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    files, at = _files(spark, path)
    return [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []


def _versions(spark: SparkSession, path: str, last: int | None = None) -> dict[int, list[int]]:
    """Of each bucket the batches, in order, whose folder is complete and holds it, up to ``last``."""
    out: dict[int, list[int]] = {}
    for number in sorted(int(n) for n in _names(spark, path) if n.isdigit()):
        inside = _names(spark, f"{path}/{number}") if last is None or number <= last else []
        if "_SUCCESS" in inside:
            for name in inside:
                if name.startswith("_b="):
                    out.setdefault(int(name[3:]), []).append(number)
    return out


def read_upserted(spark: SparkSession, path: str, buckets: int = 64) -> DataFrame:
    """The table that ``upsert_sink`` keeps in ``path``."""
    return spark.read.parquet(*[f"{path}/{v[-1]}/_b={b}" for b, v in sorted(_versions(spark, path).items()) if b < buckets])
