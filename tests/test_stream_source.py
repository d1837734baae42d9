"""The message log from offsets, across restarts, and the metrics of its batches."""

import datetime as dt
import json
import time

from pyspark.sql import functions as F

from tideline.sources import message_log
from tideline.streaming import metrics


def message(i, **more):
    return json.dumps({"MMSI": 1000 + i, "lat": 1.0 + i % 10, "lon": 2.0, "ShipType": 80 + i % 20, "ts": f"2024-01-01T00:{i % 60:02d}:00Z"} | more) + "\n"


def drain(spark, tmp_path, **options):
    source = spark.readStream.format("message_log").option("path", f"{tmp_path}/log")
    for k, v in options.items():
        source = source.option(k, v)
    out = source.load().writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
    query = out.trigger(processingTime="0 seconds").start()
    query.processAllAvailable()
    query.stop()
    return spark.read.parquet(f"{tmp_path}/out")


def test_restarts_lose_and_repeat_nothing(spark, tmp_path, monkeypatch):
    message_log.register(spark)
    log = tmp_path / "log"
    log.mkdir()
    (log / "a.jsonl").write_text("".join(message(i) for i in range(40)) + "not json\n[1]\n" + message(40)[:-5])
    assert drain(spark, tmp_path, most_bytes=700).count() == 40
    # the open line ends, a file grows, another appears; the query goes on from its checkpoint
    with (log / "a.jsonl").open("a") as f:
        f.write(message(40)[-5:] + message(41))
    (log / "b.jsonl").write_text("".join(message(i) for i in range(100, 130)))
    found = drain(spark, tmp_path, most_bytes=700)
    assert sorted(r.mmsi for r in found.select("mmsi").collect()) == [1000 + i for i in [*range(42), *range(100, 130)]]
    assert drain(spark, tmp_path).count() == 72 and found.select("file", "at").distinct().count() == 72


def test_boxes_and_types(spark, tmp_path):
    message_log.register(spark)
    (tmp_path / "log").mkdir()
    lines = [message(i) for i in range(40)] + [message(50, lat=None), message(51, ShipType=None), "{}\n"]
    (tmp_path / "log" / "a.jsonl").write_text("".join(lines))
    found = drain(spark, tmp_path, boxes="[[0, 0, 3.5, 5], [8.5, 0, 20, 5]]", ship_types="80-89")
    assert sorted(r.mmsi - 1000 for r in found.collect()) == [i for i in range(40) if i % 20 < 10 and (1 + i % 10 <= 3.5 or 1 + i % 10 >= 8.5)]


def test_spans_share_no_line(tmp_path, monkeypatch):
    (tmp_path / "a.jsonl").write_text("".join(message(i, note="é" * (i % 7)) for i in range(60)))
    reader = message_log.LogReader({"path": str(tmp_path)})
    end = reader.latestOffset()
    for size in (1, 7, 64, 1000, 1 << 20):
        monkeypatch.setattr(message_log, "RANGE", size)
        assert [row[2] for span in reader.partitions({}, end) for row in reader.read(span)] == [1000 + i for i in range(60)]
    assert message_log.LogReader({"path": str(tmp_path), "most_bytes": "10"}).latestOffset() == {"a.jsonl": len(message(0, note=""))}


def test_batches_are_told(spark, tmp_path):
    ddl = "mmsi long, ts timestamp, kind string"
    now = dt.datetime(2024, 1, 1)
    for k in range(3):
        rows = [(i, now + dt.timedelta(minutes=10 * k + i), "gate" if i == k else None) for i in range(4)]
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    listener = metrics.BatchLog(spark, "fixes_seen", f"{tmp_path}/metrics", every_s=1.0)
    spark.streams.addListener(listener)
    try:
        fixes = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = metrics.watched(fixes, "fixes_seen", "ts", {"gate": F.col("kind") == "gate"}).writeStream.format("noop").trigger(processingTime="1 second").start()
        query.processAllAvailable()
        deadline = time.time() + 30
        while time.time() < deadline and len(list((tmp_path / "metrics").glob("*.json")) if (tmp_path / "metrics").exists() else []) < 3:
            time.sleep(0.2)
        query.stop()
    finally:
        spark.streams.removeListener(listener)
    table = metrics.batch_table(spark, f"{tmp_path}/metrics")
    told = table.where("rows > 0").orderBy("batch").collect()
    assert [r.rows for r in told] == [4, 4, 4] and [r.counts["gate"] for r in told] == [1, 1, 1]
    assert told[0].late_s is None and all(r.jitter >= 0 and r.took_s > 0 and r.behind_s > 0 for r in told[1:])
    health = metrics.health_of(table, most_behind_s=60).first()
    assert (health.rows, health.stale) == (12, True) and health.newest.replace(tzinfo=None) >= now + dt.timedelta(minutes=13)
