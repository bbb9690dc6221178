"""A walk of a mounted folder tree that tells what it could not read. Each level of folders is listed in parallel."""

from __future__ import annotations

import os
import stat
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from silt.operators import graph

ROWS = 4096  # entries in one batch
FIELDS = {"kind": pa.string(), "path": pa.string(), "size": pa.int64(), "modified": pa.float64(), "accessed": pa.float64(), "changed": pa.float64()}


def _lister(without: Sequence[str], excluded: Sequence[str], one_device: bool, links: bool):
    def out_of_scope(path: str) -> bool:
        return any(part in path for part in without) or any(path == e or path.startswith(f"{e.rstrip('/')}/") for e in excluded)

    def listed(folder: str) -> Iterator[tuple]:
        try:
            with os.scandir(folder) as entries:
                for e in entries:
                    try:
                        s = e.stat(follow_symlinks=links)
                    except OSError:
                        continue
                    if stat.S_ISDIR(s.st_mode) and not e.is_symlink():
                        if not out_of_scope(e.path) and not (one_device and os.path.ismount(e.path)):
                            yield "folder", e.path, None, s.st_mtime, s.st_atime, s.st_ctime
                    elif stat.S_ISREG(s.st_mode) and not out_of_scope(e.path):
                        yield "file", e.path, s.st_size, s.st_mtime, s.st_atime, s.st_ctime
        except OSError:
            yield "failed", folder, None, None, None, None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                for rows in batched(listed(folder), ROWS):  # a folder may have any number of entries
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), FIELDS.values(), strict=True)], names=list(FIELDS))

    return run


def walk(spark: SparkSession, top: str, without: Sequence[str] = (), excluded: Sequence[str] = (), one_device: bool = False, links: bool = False) -> tuple[DataFrame, DataFrame]:
    """(files, failed): (path, size, modified, accessed, changed) of regular files below ``top``, and the folders that could not be listed.

    Entries that vanish or cannot be read are skipped; paths that hold a token of ``without``, and what lies below a prefix of
    ``excluded``, are left out; with ``one_device`` mounted folders are too. Linked folders are never entered, linked files only
    with ``links``. All executors must see the tree under the same path.
    """
    schema = "kind string, path string, size long, modified double, accessed double, changed double"
    levels: list[DataFrame] = []
    folders = spark.createDataFrame([(top,)], "path string")
    while True:
        wide = folders if not levels else folders.repartition("path")
        levels.append(graph._cut(wide.mapInArrow(_lister(without, excluded, one_device, links), schema)))
        folders = levels[-1].filter("kind = 'folder'").select("path")
        if folders.isEmpty():
            break
    rows = levels[0]
    for level in levels[1:]:
        rows = rows.unionByName(level)
    return rows.filter("kind = 'file'").drop("kind"), rows.filter("kind = 'failed'").select("path")


def visited(spark: SparkSession, top: str, action: Callable[[str], Iterable[tuple]], schema: str, **scope) -> tuple[DataFrame, DataFrame]:
    """(rows, failed): what ``action`` yields for each file of a walk, behind its path, and (path, error) of files that it failed on.

    ``schema`` names and types the columns of its tuples; ``scope`` are the bounds of ``walk``. Files are visited by many tasks; a
    task that is run again visits its files again, so an action must not mind that.
    """
    files, _ = walk(spark, top, **scope)
    kind = StructType([StructField("path", StringType()), StructField("found", ArrayType(StructType.fromDDL(schema))), StructField("error", StringType())])
    arrow = to_arrow_schema(kind)
    names = StructType.fromDDL(schema).names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found, error = [], None
                try:
                    found = [dict(zip(names, row, strict=True)) for row in action(path)]
                except Exception as e:  # noqa: BLE001 - one file's fault is a row, not the end of the walk
                    found, error = [], f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((path, found, error), arrow.types, strict=True)], schema=arrow)

    seen = graph._cut(files.select("path").repartition("path").mapInArrow(run, kind))
    return seen.select("path", F.inline("found")), seen.filter("error IS NOT NULL").select("path", "error")


def latest(files: DataFrame, by: str = "modified", n: int | None = None) -> DataFrame:
    """Files by one of their times, newest last; of the newest n if asked for."""
    return files.orderBy(by, "path") if n is None else files.orderBy(F.desc(by), "path").limit(n).orderBy(by, "path")


def prefixes(lines: DataFrame, line: str = "line") -> list[str]:
    """The excluded prefixes of a file's lines; blank lines and comments go. A configuration file, so it is collected."""
    t: Column = F.trim(F.col(line))
    return [r.p for r in lines.select(t.alias("p")).filter((F.col("p") != "") & ~F.col("p").startswith("#")).collect()]
