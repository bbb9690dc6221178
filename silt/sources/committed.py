"""Writers of many small or ordered files that publish all or nothing.

Tasks write below a staging folder beside the target. When all have ended, one rename puts the folder in place (or, where
rows are appended to a folder that is there, its files are moved in). A task that fails, or is run twice, leaves nothing
that counts: only what the one successful attempt of each task reports is published, and the staging folder goes in any case.

``silt_files`` writes one file a row (name, content); a name that repeats, or leads out of the folder, fails the write.
``silt_logs`` writes rows (stream, line) that are sorted and range-partitioned by time, in one pass, into a folder for each
stream and into the log of all, ``merged``; files of one folder, by name, follow one another in time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from silt.sources.captures import opened


#: Files that a task holds at once.
AT_ONCE = 256


@dataclass
class Written(WriterCommitMessage):
    """What one task attempt wrote: its folder, and files in it."""

    folder: str
    files: list[str] = field(default_factory=list)


class Staged(DataSourceWriter):
    """Subclasses write a task's rows below ``folder`` and name the files."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staging = f"{self.path}_staging_{uuid.uuid4().hex}"

    def put(self, store: fs.FileSystem, folder: str, rows: Iterator[Row], task: int) -> list[str]:
        raise NotImplementedError

    def write(self, iterator: Iterator[Row]) -> Written:
        store, at = opened(self.staging)
        folder = f"{at}/{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=True)
        return Written(folder, self.put(store, folder, iterator, TaskContext.get().partitionId()))

    def commit(self, messages: list[Written | None]) -> None:
        store, at = opened(self.path)
        _, staging = opened(self.staging)
        moves = [(f"{m.folder}/{f}", f) for m in messages if m for f in m.files]
        try:
            names = [f for _, f in moves]
            if len(names) != len(set(names)):
                raise ValueError(f"names repeat, such as {next(n for n in names if names.count(n) > 1)!r}")
            there = store.get_file_info(at).type != fs.FileType.NotFound
            target = at if there and not self.overwrite else f"{staging}/all"
            for folder in {f"{target}/{f}".rpartition("/")[0] for f in names} | {target}:
                store.create_dir(folder, recursive=True)
            for source, f in moves:
                store.move(source, f"{target}/{f}")
            if target != at:
                if there:
                    store.delete_dir(at)
                store.move(target, at)
        finally:
            self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, staging = opened(self.staging)
        if store.get_file_info(staging).type != fs.FileType.NotFound:
            store.delete_dir(staging)


class FileWriter(Staged):
    def put(self, store, folder, rows, task):
        names: list[str] = []
        for name, content in rows:
            if not name or name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"{name!r} is no name inside the folder")
            if "/" in name:
                store.create_dir(f"{folder}/{name.rpartition('/')[0]}", recursive=True)
            with store.open_output_stream(f"{folder}/{name}") as out:
                out.write(bytes(content or b""))
            names.append(name)
        return names


class LogWriter(Staged):
    def put(self, store, folder, rows, task):
        open_: dict[str, object] = {}
        try:
            for stream, line in rows:
                raw = (line or "").encode("utf-8", "surrogatepass") + b"\n"
                for name in ("merged", stream):
                    at = f"{name}/part-{task:06d}.log"
                    if at not in open_:
                        store.create_dir(f"{folder}/{name}", recursive=True)
                        open_[at] = store.open_output_stream(f"{folder}/{at}")
                    open_[at].write(raw)
        finally:
            for out in open_.values():
                out.close()
        return list(open_)


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return "silt_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], overwrite)


class Logs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "silt_logs"

    def schema(self) -> str:
        return "stream string, line string"

    def writer(self, schema: StructType, overwrite: bool) -> LogWriter:
        return LogWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Files)
    spark.dataSource.register(Logs)


def write_files(df: DataFrame, path: str, name: str, content: str, mode: str = "overwrite") -> None:
    """One file a row, all or none. Tasks are handed ``AT_ONCE`` whole files at a time."""
    spark, size = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    register(spark)
    before = spark.conf.get(size)
    spark.conf.set(size, min(AT_ONCE, int(before)) if int(before) > 0 else AT_ONCE)
    try:
        df.select(F.col(name).cast("string").alias("name"), F.col(content).cast("binary").alias("content")).write.format("silt_files").mode(mode).option("path", path).save()
    finally:
        spark.conf.set(size, before)


def write_logs(df: DataFrame, path: str, stream: str, at: str, line: Column, parts: int | None = None, mode: str = "overwrite") -> None:
    """A log for each stream and ``merged``, the log of all in order of time (ties: by stream, then line), from one pass."""
    register(df.sparkSession)
    rows = df.filter(F.col(stream).isNotNull() & (F.col(stream) != "merged")).select(F.col(at).alias("at"), F.col(stream).cast("string").alias("stream"), line.cast("string").alias("line"))
    keys = ["at", "stream", "line"]
    ranged = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).select("stream", "line").write.format("silt_logs").mode(mode).option("path", path).save()
