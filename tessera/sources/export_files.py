"""Folders of export files as a data source with checkpoints: whole, by range, what changed since, or as a stream.

``register`` makes the format ``export_files`` known to a session.  A
checkpoint is a JSON text with the last time of change that was read and the
names of the files of that time, so that a file that comes later with the same
time isn't lost.  It is the offset of the stream reader as well.  The folder is
a path that driver and executors share; other file systems are read by
``exports.read_exports``.  Files are taken to be written once.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tessera.sources.exports import SCHEMAS, evidence

FORMAT = "export_files"
ROW = "path string, modified_ns long, content string"
#: Bytes of files that one task reads; a larger file is a task of its own.
TASK_BYTES = 64 << 20
START = {"time": -1, "names": []}


@dataclass
class Files(InputPartition):
    """Files that one task reads: path and time of change."""

    files: list[tuple[str, int]]


def listed(folder: str) -> list[tuple[str, int, int]]:
    """(path, time of change, bytes) of every file below ``folder`` in order of path; hidden ones are left out, a missing folder is empty."""
    out = []
    for place, folders, names in os.walk(folder):
        folders[:] = [f for f in folders if f[0] not in "._"]
        for name in names:
            if name[0] not in "._":
                path = os.path.join(place, name)
                info = os.stat(path)
                out.append((path, info.st_mtime_ns, info.st_size))
    return sorted(out)


def latest(folder: str, start: dict) -> dict:
    """The checkpoint of all files there are now; never before ``start``."""
    files = listed(folder)
    time = max((t for _, t, _ in files), default=-1)
    if time < start["time"]:
        return start
    names = {p for p, t, _ in files if t == time}
    return {"time": time, "names": sorted(names | set(start["names"] if time == start["time"] else []))}


def between(folder: str, start: dict, end: dict) -> list[Files]:
    """What is after ``start`` and not after ``end``, packed for tasks."""
    after = lambda p, t, at: t > at["time"] or t == at["time"] and p not in at["names"]
    out, held = [], 0
    for path, time, size in listed(folder):
        if after(path, time, start) and not after(path, time, end):
            if not out or held + size > TASK_BYTES:
                out, held = [*out, Files([])], 0
            out[-1].files.append((path, time))
            held += size
    return out


def rows(part: Files) -> Iterator[tuple]:
    for path, time in part.files:
        with open(path, encoding="utf-8", errors="replace") as f:
            yield path, time, f.read()


class ExportFiles(DataSource):
    """Options: ``path``; ``since``, a checkpoint that the batch reader starts after."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> DataSourceReader:
        return FilesReader(self.options["path"], json.loads(self.options.get("since", json.dumps(START))))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FilesStreamReader(self.options["path"])


class FilesReader(DataSourceReader):
    def __init__(self, folder: str, since: dict):
        self.folder, self.since = folder, since

    def partitions(self) -> list[InputPartition]:
        return between(self.folder, self.since, latest(self.folder, self.since)) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows(partition)


class FilesStreamReader(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder, self.known = folder, START

    def initialOffset(self) -> dict:
        return START

    def latestOffset(self) -> dict:
        self.known = latest(self.folder, self.known)
        return self.known

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.known = end
        return between(self.folder, start, end)

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows(partition)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ExportFiles)


def checkpoint(path: str) -> str:
    """The checkpoint of what is at ``path`` now; taken before a read, nothing is missed by the next."""
    return json.dumps(latest(path, START))


def _evidence(files: DataFrame, kind: str) -> DataFrame:
    return evidence(files.select(F.from_json("content", SCHEMAS[kind]).alias("r")).select("r.*"), kind)


def backfill(spark: SparkSession, path: str, kind: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Evidence rows with ``start <= occurred_at < end``; undated rows pass, as nobody knows that they don't belong."""
    register(spark)
    out = _evidence(spark.read.format(FORMAT).option("path", path).load(), kind)
    at = F.col("occurred_at")
    if start is not None:
        out = out.where(at.isNull() | (at >= F.lit(start).cast("timestamp_ntz")))
    return out if end is None else out.where(at.isNull() | (at < F.lit(end).cast("timestamp_ntz")))


def changes(spark: SparkSession, path: str, kind: str, since: str | None) -> DataFrame:
    """Evidence rows of the files that came after checkpoint ``since``; without a checkpoint none, as a backfill has to come first."""
    register(spark)
    files = spark.read.format(FORMAT).option("path", path).option("since", since or checkpoint(path)).load()
    return _evidence(files if since else files.limit(0), kind)


def changes_stream(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Evidence rows of new files; the stream's own checkpoint says which."""
    register(spark)
    return _evidence(spark.readStream.format(FORMAT).option("path", path).load(), kind)
