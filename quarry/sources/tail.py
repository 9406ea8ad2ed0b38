"""A streaming source of appended lines: byte offsets of every file, and whole lines alone.

An offset says, for each file, how many bytes have been read; it ends after a line feed, so the
torn last line of a file stays unread until its end has arrived. New bytes of a file are dealt to
tasks by ranges; a line belongs to the range in which it begins. A stream that is started again
with its checkpoint reads on from there. Files are listed by the driver, as Spark's own file source does.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a range; bytes that are looked at at a time for the last line feed; lines of a batch.
RANGE_BYTES, LOOK_BYTES, BATCH_LINES = 64 << 20, 1 << 16, 10_000


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """(filesystem, path in it) of a plain path or an address."""
    return fs.FileSystem.from_uri("/" + path[5:].lstrip("/") if path.startswith("file:") else path)


@dataclass
class Range(InputPartition):
    path: str
    whole_from: int  # where the unread part of the file begins
    begin: int
    end: int


def end_of_lines(source, begin: int, size: int) -> int:
    """The place after the last line feed between begin and size; begin if there is none."""
    at = size
    while at > begin:
        start = max(begin, at - LOOK_BYTES)
        source.seek(start)
        found = source.read(at - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        at = start
    return begin


def lines_of(part: Range) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in a range; its file has a line feed at or after the range's end."""
    filesystem, place = opened(part.path)
    with io.BufferedReader(filesystem.open_input_file(place), 1 << 20) as source:
        at = part.begin
        if at > part.whole_from:  # the line that runs into the range belongs to the one before
            source.seek(at - 1)
            at += len(source.readline()) - 1
        else:
            source.seek(at)
        while at < part.end:
            line = source.readline()
            yield at, line.rstrip(b"\n")
            at += len(line)


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.suffix = options["path"], options.get("suffix", ".jsonl")
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.read_to: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        filesystem, place = opened(self.path)
        for info in filesystem.get_file_info(fs.FileSelector(place, recursive=True, allow_not_found=True)):
            known = self.read_to.get(info.path, 0)
            if info.type == fs.FileType.File and info.path.endswith(self.suffix) and info.size > known:
                with filesystem.open_input_file(info.path) as source:
                    end = end_of_lines(source, known, info.size)
                if end > known:
                    self.read_to[info.path] = end
        return {"files": dict(self.read_to)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, stop in sorted(end["files"].items()):
            begin = start["files"].get(path, 0)
            out += [Range(path, begin, at, min(at + self.range_bytes, stop)) for at in range(begin, stop, self.range_bytes)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str]] = []
        for at, line in lines_of(partition):
            held.append((at, line.decode("utf-8", "replace")))
            if len(held) == BATCH_LINES:
                yield self._batch(partition.path, held)
                held = []
        if held:
            yield self._batch(partition.path, held)

    @staticmethod
    def _batch(path: str, held: list[tuple[int, str]]) -> pa.RecordBatch:
        at, value = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array([path] * len(held)), pa.array(at, pa.int64()), pa.array(value, pa.string())], names=["path", "at", "value"])

    def commit(self, end: dict) -> None:
        """Offsets are kept by the stream's checkpoint alone."""


class Tail(DataSource):
    """Format `tail`: (path, at, value) of appended lines. Options: path, suffix (.jsonl), range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "path string, at long, value string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tailed(spark: SparkSession, path: str, **options: str | int):
    """A stream of the lines appended to the files under path."""
    spark.dataSource.register(Tail)
    return spark.readStream.format("tail").options(**options).load(path)
