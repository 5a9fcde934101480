"""Growing line files as a stream whose offsets are places in files, in bytes.

A folder's files, or one file, are read from where the last batch ended. A last line without its line break is still being
written and is held back until it is whole. Each batch is cut into parts of bounded size, so a large file is read by many tasks; the
checkpoint holds one number for each file.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a part, of a look back for a line's end, and of lines handed on at once.
PART, LOOK, BATCH = 64 << 20, 1 << 16, 4 << 20


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Part(InputPartition):
    file: str
    low: int
    high: int


class LineTail(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.suffix, self.part = options["path"], options.get("suffix", ""), int(options.get("part", PART))

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        system, path = store(self.path)
        info = system.get_file_info(path)
        files = [] if info.type == fs.FileType.NotFound else [info] if info.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        found = {f.path: whole_lines(system, f) for f in files if f.is_file and f.path.endswith(self.suffix) and not f.base_name.startswith(("_", "."))}
        return {"files": {p: n for p, n in sorted(found.items()) if n}}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        out = []
        for file, high in end["files"].items():
            low = start["files"].get(file, 0)
            if high < low:
                raise ValueError(f"{file} has shrunk from {low} to {high} bytes")
            out += [Part(file, lo, min(high, lo + self.part)) for lo in range(low, high, self.part)]
        for file in start["files"].keys() - end["files"].keys():
            raise ValueError(f"{file} is gone")
        return out or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        """The lines that begin in a part; its last one may end beyond it, as only whole lines are in a batch."""
        if not partition.file:
            return
        system, _ = store(self.path)
        with system.open_input_file(partition.file) as f:
            at = partition.low
            if at and not (f.seek(at - 1) is not None and f.read(1) == b"\n"):
                at = line_end(f, at)
            f.seek(at)
            held, starts, lines, size = b"", [], [], 0
            while at < partition.high:
                data = f.read(LOOK)
                if not data:
                    break
                *whole, held = (held + data).split(b"\n")
                for line in whole:
                    if at >= partition.high:
                        break
                    starts.append(at)
                    lines.append(line)
                    at, size = at + len(line) + 1, size + len(line)
                if size > BATCH:
                    yield self._batch(partition.file, starts, lines)
                    starts, lines, size = [], [], 0
            if lines:
                yield self._batch(partition.file, starts, lines)

    def _batch(self, file: str, starts: list[int], lines: list[bytes]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([file] * len(lines)), pa.array(starts, pa.int64()), pa.array([x.decode("utf-8", "replace") for x in lines])], names=["file", "at", "line"])


def line_end(f, at: int) -> int:
    """Where the line that holds byte at ends, its break included."""
    f.seek(at)
    while data := f.read(LOOK):
        if (n := data.find(b"\n")) >= 0:
            return at + n + 1
        at += len(data)
    return at


def whole_lines(system: fs.FileSystem, info: fs.FileInfo) -> int:
    """The bytes of a file up to its last line break."""
    high = info.size
    with system.open_input_file(info.path) as f:
        while high > 0:
            low = max(0, high - LOOK)
            f.seek(low)
            if (n := f.read(high - low).rfind(b"\n")) >= 0:
                return low + n + 1
            high = low
    return 0


class LineTailSource(DataSource):
    """Format line_tail: file, at (the line's first byte), line. Options: path; suffix of the files' names; part, the bytes of a part."""

    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return "file string, at bigint, line string"

    def streamReader(self, schema) -> LineTail:
        return LineTail(self.options)


def tail_lines(spark: SparkSession, path: str, suffix: str = "", part: int = PART) -> DataFrame:
    """file, at, line of a growing file, or of a folder's, as a stream. A file that shrinks or goes is an error; an absent path is empty."""
    spark.dataSource.register(LineTailSource)
    return spark.readStream.format("line_tail").option("suffix", suffix).option("part", part).load(path)


def tail_events(spark: SparkSession, path: str, schema: str, suffix: str = "", part: int = PART) -> DataFrame:
    """file, at, and the columns of JSON lines under a declared schema; blank lines drop out, a line that is no JSON object is an error."""
    lines = tail_lines(spark, path, suffix, part).filter(F.btrim("line") != "")
    return lines.select("file", "at", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("e")).select("file", "at", "e.*")
