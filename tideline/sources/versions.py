"""Tables in versions: a reader is pinned to one list of files, a writer adds files and then one list.

``path/data`` holds files that are never changed; ``path/versions/<n>.json`` lists the files of version n with the least
and greatest value of the table's range column. A list is written beside and takes its name by a rename that fails if
the name is taken, so a version is there whole or not at all, a failed publish leaves the one before, and of two
writers the slower one is told. Rows of a range are replaced by writing anew only the files whose bounds meet it.

Cases: rows whose range column is null are in no range; a range that meets no file only adds files; a table may be
published empty; reading a path without versions is an error.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructType, TimestampNTZType, TimestampType


class Conflict(RuntimeError):
    """Another writer has published the version that this one was to become."""


def _rank(column: Column, kind) -> Column:
    """A number that orders a time, a date or a number."""
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.unix_micros(column.cast("timestamp"))
    return F.unix_date(column) if isinstance(kind, DateType) else column


def _jvm(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the versions there are, in order."""
    files, at = _jvm(spark, f"{path}/versions")
    names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """``number, schema, column, files`` (name, low, high, rows) of a version, the newest by default."""
    found = versions(spark, path)
    if not found or version is not None and version not in found:
        raise FileNotFoundError(f"{path} has no version {'' if version is None else version}")
    number = found[-1] if version is None else version
    files, at = _jvm(spark, f"{path}/versions/{number}.json")
    stream = files.open(at)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return {"number": number, **json.loads(text)}


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of a table, the newest by default; what is published later doesn't change the frame."""
    return _frame(spark, path, manifest(spark, path, version))


def _frame(spark: SparkSession, path: str, listed: dict, names: list[str] | None = None) -> DataFrame:
    schema = StructType.fromJson(listed["schema"])
    chosen = [f["name"] for f in listed["files"]] if names is None else names
    return spark.read.schema(schema).parquet(*[f"{path}/data/{n}" for n in chosen]) if chosen else spark.createDataFrame([], schema)


def _written(rows: DataFrame, path: str, column: str) -> list[dict]:
    """The files of ``rows``, newly written, with the bounds of ``column``."""
    spark, folder = rows.sparkSession, uuid.uuid4().hex
    rows.write.parquet(f"{path}/data/{folder}")
    value = _rank(F.col(column), rows.schema[column].dataType)
    back = spark.read.schema(rows.schema).parquet(f"{path}/data/{folder}")
    # one row for each file
    told = back.groupBy(F.col("_metadata.file_name").alias("name")).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("rows"))
    return [r.asDict() | {"name": f"{folder}/{r.name}"} for r in told.collect()]


def _commit(spark: SparkSession, path: str, listed: dict, number: int) -> int:
    """Give a list the name of version ``number``, if nobody has."""
    jvm = spark.sparkContext._jvm
    files, beside = _jvm(spark, f"{path}/versions/.{uuid.uuid4().hex}")
    out = files.create(beside, False)
    out.write(bytearray(json.dumps(listed).encode()))
    out.close()
    target = files.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{number}.json"))
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    never = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(files.makeQualified(beside), target, never)
    except Exception as error:
        files.delete(beside, False)
        if number in versions(spark, path):
            raise Conflict(f"version {number} of {path} was published meanwhile") from error
        raise
    return number


def publish(rows: DataFrame, path: str, column: str, check: Callable[[DataFrame], bool] | None = None) -> int:
    """Make ``rows`` the next version of the table in ``path``, if ``check`` finds them fit as written; gives its number."""
    spark = rows.sparkSession
    number = max(versions(spark, path), default=0) + 1
    listed = {"schema": rows.schema.jsonValue(), "column": column, "files": _written(rows, path, column)}
    if check is not None and not check(_frame(spark, path, listed)):
        raise ValueError(f"the rows for version {number} of {path} did not pass their check")
    return _commit(spark, path, listed, number)


def replace_range(fresh: DataFrame, path: str, low, high) -> int:
    """The next version: rows with ``low`` <= column < ``high`` go, ``fresh`` come; only files whose bounds meet the range are written anew."""
    spark = fresh.sparkSession
    listed = manifest(spark, path)
    column, schema = listed["column"], StructType.fromJson(listed["schema"])
    kind = schema[column].dataType
    bounds = spark.range(1).select(*[_rank(F.lit(x).cast(kind), kind) for x in (low, high)]).first()
    met = [f["name"] for f in listed["files"] if f["low"] is not None and f["low"] < bounds[1] and f["high"] >= bounds[0]]
    value = F.col(column)
    inside = F.coalesce((value >= F.lit(low).cast(kind)) & (value < F.lit(high).cast(kind)), F.lit(False))
    rest = _frame(spark, path, listed, met).where(~inside)
    rows = rest.unionByName(fresh.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]))
    files = [f for f in listed["files"] if f["name"] not in met] + _written(rows.coalesce(max(1, len(met))), path, column)
    return _commit(spark, path, {"schema": listed["schema"], "column": column, "files": files}, listed["number"] + 1)


def forget(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Delete all but the last ``keep`` versions, and files that only they list; gives their numbers. Not while a writer is at work."""
    found = versions(spark, path)
    gone, kept = found[:-keep], found[-keep:]
    used = {f["name"] for n in kept for f in manifest(spark, path, n)["files"]}
    old = {f["name"] for n in gone for f in manifest(spark, path, n)["files"]} - used
    for number in gone:
        files, at = _jvm(spark, f"{path}/versions/{number}.json")
        files.delete(at, False)
    for name in old:
        files, at = _jvm(spark, f"{path}/data/{name}")
        files.delete(at, False)
    return gone
