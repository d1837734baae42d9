"""What each batch of a stream brought: counts observed in its plan, and when it ran, kept as a table.

Counts are gathered while the batch's rows pass (``observe``), so they cost no job. A listener adds when the batch was
due and when it began, how long it took and how far its newest event lies behind, and writes one small file for each
batch into a folder that any session reads as a table.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from tideline.functions.columns import epoch_seconds

METRICS_DDL = (
    "name string, run string, batch long, began timestamp, took_s double, rows long, late_s double, jitter double, newest timestamp, behind_s double, counts map<string, long>"
)


def watched(rows: DataFrame, name: str, ts: str, counts: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with the metrics ``name``: their number, the newest ``ts``, and how many meet each of ``counts``."""
    told = [F.count_if(F.coalesce(when, F.lit(False))).alias(f"n_{key}") for key, when in (counts or {}).items()]
    return rows.observe(name, F.count(F.lit(1)).alias("rows"), F.max(epoch_seconds(ts)).alias("newest"), *told)


class BatchLog(StreamingQueryListener):
    """Writes a row for each batch of queries that carry the metrics ``name``.

    ``every_s`` is the interval of the trigger: ``late_s`` tells by how much a batch began after it was due (counted
    from the one before), ``jitter`` the same as a share of the interval. ``behind_s`` is the age of the newest event
    when the batch began.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, every_s: float | None = None):
        self.spark, self.name, self.path, self.every_s = spark, name, path, every_s
        self.before: dict[str, float] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.before.pop(str(event.runId), None)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        seen = progress.observedMetrics.get(self.name)
        if seen is None:
            return
        seen, run = seen.asDict(), str(progress.runId)
        began = dt.datetime.fromisoformat(progress.timestamp.replace("Z", "+00:00")).timestamp()
        late = began - self.before[run] - self.every_s if self.every_s and run in self.before else None
        self.before[run] = began
        newest = seen.get("newest")
        row = {
            "name": self.name, "run": run, "batch": progress.batchId, "began": _told(began), "took_s": progress.durationMs.get("triggerExecution", 0) / 1000,
            "rows": seen["rows"], "late_s": late, "jitter": abs(late) / self.every_s if late is not None else None, "newest": _told(newest),
            "behind_s": began - newest if newest is not None else None, "counts": {k[2:]: v for k, v in seen.items() if k.startswith("n_")},
        }
        self._write(f"{run}-{progress.batchId:012d}.json", json.dumps(row))

    def _write(self, name: str, line: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        files = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        out = files.create(at, True)
        out.write(bytearray(line.encode()))
        out.close()


def _told(seconds: float | None) -> str | None:
    return None if seconds is None else dt.datetime.fromtimestamp(seconds, dt.timezone.utc).isoformat()


def batch_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``BatchLog`` wrote."""
    return spark.read.schema(METRICS_DDL).json(path)


def health_of(batches: DataFrame, most_behind_s: float, most_jitter: float = 0.1) -> DataFrame:
    """By query: batches, rows, share of batches that were late by more than ``most_jitter``, age of the newest event at the last batch, and whether it is too old."""
    last = F.max_by(F.struct("behind_s", "newest"), "began")
    late = F.avg(F.when(F.col("jitter").isNotNull(), (F.col("jitter") > most_jitter).cast("int")))
    return batches.groupBy("name").agg(F.count(F.lit(1)).alias("batches"), F.sum("rows").alias("rows"), late.alias("late_share"), last.alias("_l")).select(
        "name", "batches", "rows", "late_share", F.col("_l.newest").alias("newest"), F.col("_l.behind_s").alias("behind_s"), (F.col("_l.behind_s") > most_behind_s).alias("stale")
    )
