"""Versions of a table: readers pinned to one, writers that fail or meet, and ranges replaced file by file."""

import pytest
from pyspark.sql import functions as F

from tideline.sources import versions


def hours(spark, n, value="a"):
    """A row for each hour from 2024-01-01 on, a file for each day."""
    return spark.range(n).select((F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=F.col("id").cast("int"))).alias("ts"), "id", F.lit(value).alias("v"))


def by_day(rows):
    return rows.repartitionByRange(4, F.to_date("ts"))


def test_a_reader_keeps_its_version(spark, tmp_path):
    path = str(tmp_path)
    assert versions.publish(by_day(hours(spark, 96)), path, "ts") == 1
    old = versions.read_version(spark, path)
    assert versions.publish(hours(spark, 5, "b"), path, "ts") == 2
    assert old.count() == 96 and versions.read_version(spark, path).count() == 5 and versions.read_version(spark, path, 1).count() == 96
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, path, 7)


def test_a_failed_publish_leaves_the_version_before(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, path)
    versions.publish(hours(spark, 10), path, "ts")
    with pytest.raises(ValueError, match="check"):
        versions.publish(hours(spark, 3), path, "ts", check=lambda rows: rows.count() > 5)
    broken = hours(spark, 3).withColumn("v", F.raise_error(F.lit("no rows today")).cast("string"))
    with pytest.raises(Exception, match="no rows today"):
        versions.publish(broken, path, "ts")
    assert versions.versions(spark, path) == [1] and versions.read_version(spark, path).count() == 10
    # two writers begin from the same version: the second is told
    seen = versions.versions(spark, path)
    monkeypatch.setattr(versions, "versions", lambda *_: list(seen))
    assert versions.publish(hours(spark, 4), path, "ts") == 2
    monkeypatch.undo()
    listed = versions.manifest(spark, path, 1)
    with pytest.raises(versions.Conflict):
        versions._commit(spark, path, {k: listed[k] for k in ("schema", "column", "files")}, 2)
    assert versions.read_version(spark, path).count() == 4 and not [p for p in (tmp_path / "versions").glob(".*") if not p.name.endswith(".crc")]


def test_half_a_day_is_replaced_and_other_files_stay(spark, tmp_path):
    path = str(tmp_path)
    versions.publish(by_day(hours(spark, 96)).unionByName(spark.createDataFrame([(None, -1, "none")], "ts timestamp, id long, v string")), path, "ts")
    before = {f["name"]: f for f in versions.manifest(spark, path)["files"]}
    fresh = hours(spark, 96, "new").where("id BETWEEN 30 AND 32")
    versions.replace_range(fresh, path, "2024-01-02 00:00:00", "2024-01-02 12:00:00")
    after = {f["name"] for f in versions.manifest(spark, path)["files"]}
    assert len(before.keys() - after) == 1 and len(after - before.keys()) == 1
    rows = versions.read_version(spark, path).collect()
    assert sorted(r.id for r in rows) == [-1, *range(24), 30, 31, 32, *range(36, 96)] and {r.id for r in rows if r.v == "new"} == {30, 31, 32}
    # a range beyond the table only adds; the old versions go with what only they hold
    versions.replace_range(hours(spark, 200, "later").where("id > 190"), path, "2024-01-08", "2024-01-10")
    assert after < {f["name"] for f in versions.manifest(spark, path)["files"]}
    assert versions.forget(spark, path) == [1] and versions.read_version(spark, path).count() == 97 - 12 + 3 + 9
    assert not (tmp_path / "data" / next(iter(before.keys() - after))).exists()


def test_dates_numbers_and_empty_tables(spark, tmp_path):
    for k, cast in enumerate(("int", "double")):
        path = f"{tmp_path}/{k}"
        rows = spark.range(20).select(F.col("id").cast(cast).alias("x"))
        versions.publish(rows.repartitionByRange(4, "x"), path, "x")
        versions.replace_range(rows.limit(0), path, 5, 10)
        assert sorted(r.x for r in versions.read_version(spark, path).collect()) == [*range(5), *range(10, 20)]
    days = spark.range(9).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    versions.publish(days, f"{tmp_path}/d", "d")
    versions.replace_range(days.limit(0), f"{tmp_path}/d", "2024-01-02", "2024-01-04")
    assert versions.read_version(spark, f"{tmp_path}/d").count() == 7
    versions.publish(days.limit(0), f"{tmp_path}/e", "d")
    assert versions.read_version(spark, f"{tmp_path}/e").count() == 0
    versions.replace_range(days, f"{tmp_path}/e", "2024-01-01", "2025-01-01")
    assert versions.read_version(spark, f"{tmp_path}/e").count() == 9
