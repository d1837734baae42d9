"""A stream source over a log of JSON messages, with offsets that can be replayed.

The log is a folder of files to which lines are appended. An offset says how many bytes of each file have been read,
so a query that starts again from its checkpoint reads exactly the bytes that came after its last batch. A batch is cut
into ranges of bytes at line ends, one task for each. Boxes and vessel types are applied while the lines are read.

Cases: a last line without its end waits for it; lines that are no JSON objects are left out; a message without a
position passes no box, one without a type no choice of types; an empty folder gives batches without rows.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

DDL = "file string, at long, mmsi long, lat double, lon double, ship_type int, body string"
#: Bytes of a task's range; bytes read at a time to find where lines end.
RANGE, CHUNK = 1 << 25, 1 << 20


@dataclass
class Span(InputPartition):
    file: str
    start: int
    end: int


class MessageLog(DataSource):
    """``spark.readStream.format("message_log")`` with ``path``; maybe ``boxes`` (a JSON list of south, west, north, east), ``ship_types`` ("80-89") and ``most_bytes`` of a batch."""

    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> str:
        return DDL

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogReader(self.options)


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.boxes = json.loads(options["boxes"]) if "boxes" in options else None
        low, _, high = options.get("ship_types", "").partition("-")
        self.types = range(int(low), int(high or low) + 1) if low else None
        self.most = int(options.get("most_bytes", 1 << 40))
        self.seen: dict[str, int] = {}

    def _files(self):
        from pyarrow import fs

        files, folder = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        return files, folder, fs.FileSelector(folder)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """What may be read now: at most ``most_bytes`` more than was told before, up to the last end of a line."""
        files, _, selector = self._files()
        left, out = self.most, dict(self.seen)
        for info in sorted(files.get_file_info(selector), key=lambda i: i.base_name):
            start = out.get(info.base_name, 0)
            if info.is_file and info.size > start and left > 0:
                end = self._line_end(files, info.path, start, min(info.size, start + left), info.size)
                out[info.base_name], left = end, left - (end - start)
        self.seen = out
        return {name: at for name, at in out.items() if at}

    def _line_end(self, files, path: str, start: int, end: int, size: int) -> int:
        """The last end of a line up to ``end``, or else the first one after it, or else ``start``."""
        with files.open_input_file(path) as f:
            at = end
            while at > start:
                low = max(start, at - CHUNK)
                f.seek(low)
                cut = f.read(at - low).rfind(b"\n")
                if cut >= 0:
                    return low + cut + 1
                at = low
            at = end
            while at < size:
                f.seek(at)
                data = f.read(CHUNK)
                cut = data.find(b"\n")
                if cut >= 0:
                    return at + cut + 1
                at += len(data)
        return start

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.seen = {**end, **{k: max(v, end.get(k, 0)) for k, v in self.seen.items()}}
        out = []
        for name in sorted(end):
            low = start.get(name, 0)
            out += [Span(name, at, min(end[name], at + RANGE)) for at in range(low, end[name], RANGE)]
        return out

    def read(self, partition: Span) -> Iterator[tuple]:
        """Messages whose line begins in the span (its first byte belongs to a line that began before, unless a line ended there)."""
        files, folder, _ = self._files()
        with io.BufferedReader(files.open_input_file(f"{folder}/{partition.file}"), CHUNK) as f:
            at = partition.start
            if at:
                f.seek(at - 1)
                at += len(f.readline()) - 1
            while at < partition.end:
                line = f.readline()
                if not line:
                    return
                if (row := self.message(line)) is not None:
                    yield partition.file, at, *row
                at += len(line)

    def message(self, line: bytes) -> tuple | None:
        try:
            found = json.loads(line)
        except ValueError:
            return None
        if not isinstance(found, dict):
            return None
        low = {k.lower(): v for k, v in found.items()}
        number = lambda kind, *names: next((kind(low[n]) for n in names if isinstance(low.get(n), (int, float))), None)
        lat, lon, vessel = number(float, "lat", "latitude"), number(float, "lon", "longitude"), number(int, "ship_type", "shiptype")
        if self.boxes is not None and (lat is None or lon is None or not any(s <= lat <= n and w <= lon <= e for s, w, n, e in self.boxes)):
            return None
        if self.types is not None and vessel not in self.types:
            return None
        return number(int, "mmsi"), lat, lon, vessel, line.decode("utf-8", "replace").rstrip("\r\n")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MessageLog)
