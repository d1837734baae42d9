"""Shared-folder tables and Arrow batch helpers used by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A stored table has at most so many files for each core: partitions beyond that are read one after another by a task.
FILES_PER_CORE = 4

_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and Spark runs in one process (tests), a temporary folder is set instead; a cluster without
    the setting is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.tideline.shared.dir", None)
    if found:
        return found
    if not (sc.master or "").startswith(("local[", "local")) or (sc.master or "").startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = f"file://{tempfile.mkdtemp(prefix='tideline-')}"
    spark.conf.set("spark.tideline.shared.dir", found)
    return found


def new_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A path in the shared folder that no other table has; unless to ``keep``, it goes at the end of the ``scratch`` it was made in."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _OPEN and not keep:
        _OPEN[-1].append(path)
    return path


def few_files(df: DataFrame) -> DataFrame:
    """``df`` in at most FILES_PER_CORE partitions a core; as it is where executors come and go, for their number says nothing."""
    sc = df.sparkSession.sparkContext
    if sc.getConf().get("spark.dynamicAllocation.enabled", "false") == "true":
        return df
    return df.coalesce(FILES_PER_CORE * max(1, sc.defaultParallelism))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    few_files(df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder, if it is there."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def dropped(df: DataFrame) -> None:
    """Delete the table that ``stored`` gave, once nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables stored inside: write what is to stay before."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            remove(spark, path)


def small_batches(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``rows``, so that long texts don't pile up as Python objects.

    After each batch Arrow gives back what it holds unused: workers are used again by later stages.
    """
    pool = pa.default_memory_pool()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        pool.release_unused()


class Kept(dict):
    """What a worker has met, in two generations of at most half of ``most`` bytes; the older one goes when the newer is full.

    Subclasses define ``make(key)``; sizes are those of keys and values with what Python and the table add to them.
    """

    ENTRY = 200

    def __init__(self, most: int):
        self.most, self.size, self.older = most, 0, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        self.size += self.ENTRY + len(key) + len(value)
        if self.size > self.most // 2:
            self.older = dict(self)
            self.clear()
            self.size = self.ENTRY + len(key) + len(value)
        self[key] = value

    def make(self, key):
        raise NotImplementedError
