"""A catalogue on disk that survives a crash in the middle of an update.

A catalogue is a folder: ``data/`` holds what writers wrote, a folder for each write with a folder for each bucket of keys;
``published/`` holds one small file for each version, which names the folder that holds each bucket. A writer writes the
buckets that it changes, then renames its version file into place. That rename is the only step that readers see: they
take the published version of the highest number, and what it names never changes. A writer that dies before leaves the
old version; what it wrote is named by nobody and goes with ``vacuum``. Two writers that began from one version meet at the
same file name, which only one can take; the other gets ``Conflict`` and begins again.

An update rewrites only the buckets that its keys fall into. Rows go to buckets by a hash of the key, so none is crowded
unless one key is. Keys compare with nulls as equal. Of updates that repeat a key the last in ``order``, or any, is taken.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


class Conflict(RuntimeError):
    """Another writer has published the version that this one was about to publish."""


@dataclass
class Catalogue:
    """A table of rows by key below ``path``, in a store that the driver and all executors see."""

    spark: SparkSession
    path: str
    keys: Sequence[str]
    buckets: int = 64
    #: Called when all is written and nothing is published.
    before_publishing: Callable[[], None] = field(default=lambda: None, repr=False)

    # -- files

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path.rstrip("/"), *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _context(self):
        return self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the published versions, ascending."""
        fs, at = self._fs(), self._path("published")
        found = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in found if n.endswith(".json") and n[0].isdigit())

    def _manifest(self, version: int | None = None) -> dict:
        """What a version names; of the latest one unless told otherwise."""
        all_ = self.versions()
        if version is None and not all_:
            return {"version": 0, "schema": None, "buckets": {}, "about": {}}
        if version is not None and version not in all_:
            raise ValueError(f"no published version {version}")
        version = all_[-1] if version is None else version
        stream = self._fs().open(self._path("published", f"{version:012d}.json"))
        try:
            raw = bytes(stream.readAllBytes())
        finally:
            stream.close()
        return json.loads(raw)

    def _publish(self, manifest: dict) -> int:
        """Put the version file in place by one rename that fails if the name is taken."""
        self.before_publishing()
        target, temporary = self._path("published", f"{manifest['version']:012d}.json"), self._path("published", f"_{uuid.uuid4().hex}")
        out = self._fs().create(temporary, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context().rename(temporary, target, none)
        except Exception as e:
            self._fs().delete(temporary, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {manifest['version']} was published by another writer") from e
            raise
        return manifest["version"]

    # -- reading

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a published version; of the latest one unless told otherwise."""
        return self._rows(self._manifest(version))

    def _rows(self, manifest: dict, buckets: Sequence[int] | None = None) -> DataFrame:
        if manifest["schema"] is None:
            raise ValueError("nothing is published yet")
        schema = StructType.fromJson(manifest["schema"])
        named = [(b, w) for b, w in manifest["buckets"].items() if buckets is None or int(b) in set(buckets)]
        if not named:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[str(self._path("data", w, f"bucket_={b}")) for b, w in named])

    def history(self) -> DataFrame:
        """(version, operation, rows, buckets): what each published version did, how many rows it holds and buckets it wrote."""
        rows = [(m["version"], m["about"].get("operation"), m["about"].get("rows"), m["about"].get("written")) for m in map(self._manifest, self.versions())]
        return self.spark.createDataFrame(rows, "version int, operation string, rows long, buckets int")

    # -- writing

    def _bucket(self, keys: Sequence[str] | None = None) -> Column:
        return F.expr(f"CAST(pmod(xxhash64({', '.join(f'`{k}`' for k in keys or self.keys)}), {self.buckets}) AS int)")

    def _write(self, old: dict, rows: DataFrame, touched: Sequence[int] | None, operation: str) -> int:
        """Write ``rows``, all rows of the ``touched`` buckets (null: of all), and publish them with the other buckets of ``old``."""
        write = uuid.uuid4().hex
        out = rows.withColumn("bucket_", self._bucket()).repartition("bucket_")
        out.write.option("compression", "zstd").partitionBy("bucket_").parquet(str(self._path("data", write)))
        fs, at = self._fs(), self._path("data", write)
        made = [s.getPath().getName().removeprefix("bucket_=") for s in fs.listStatus(at) if s.isDirectory()]
        kept = {} if touched is None else {b: w for b, w in old["buckets"].items() if int(b) not in set(touched)}
        manifest = {"version": old["version"] + 1, "schema": rows.schema.jsonValue(), "buckets": kept | dict.fromkeys(made, write)}
        manifest["about"] = {"operation": operation, "written": len(made), "rows": self._rows(manifest).count()}  # from the files' footers
        return self._publish(manifest)

    def replace(self, rows: DataFrame) -> int:
        """Publish ``rows`` as all there is."""
        return self._write(self._manifest(), rows, None, "replace")

    def _touched(self, keys: DataFrame) -> list[int]:
        """Buckets that keys fall into: at most ``buckets`` of them."""
        return [r.b for r in keys.select(self._bucket().alias("b")).distinct().collect()]

    def upsert(self, updates: DataFrame, order: str | None = None) -> int:
        """Put rows in by key; a row of a known key is replaced whole."""
        old = self._manifest()
        one = updates
        if order is not None:
            last = Window.partitionBy(*self.keys).orderBy(F.desc(order))
            one = updates.withColumn("n_", F.row_number().over(last)).filter("n_ = 1").drop("n_")
        else:
            one = updates.dropDuplicates(list(self.keys))
        if old["schema"] is None:
            return self._write(old, one, None, "upsert")
        touched = self._touched(updates)
        base = self._rows(old, touched)
        rest = base.alias("b").join(one.select(*self.keys).alias("u"), self._same("b", "u"), "left_anti")
        return self._write(old, rest.unionByName(one.select(*base.columns)), touched, "upsert")

    def delete(self, keys: DataFrame) -> int:
        """Take out the rows of the listed keys."""
        old = self._manifest()
        touched = self._touched(keys)
        base = self._rows(old, touched)
        rest = base.alias("b").join(keys.select(*self.keys).distinct().alias("u"), self._same("b", "u"), "left_anti")
        return self._write(old, rest, touched, "delete")

    def _same(self, a: str, b: str) -> Column:
        on = F.lit(True)
        for k in self.keys:
            on = on & F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`"))
        return on

    def retried(self, change: Callable[[Catalogue], int], times: int = 5) -> int:
        """``change`` again and again, until no other writer has been faster."""
        for k in range(times):
            try:
                return change(self)
            except Conflict:
                if k + 1 == times:
                    raise
        raise AssertionError

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove all versions but the last ``keep``, and written folders that none of these names. No writer may be at work meanwhile."""
        fs, all_ = self._fs(), self.versions()
        kept = all_[-keep:] if keep else []
        named = {w for v in kept for w in self._manifest(v)["buckets"].values()}
        for v in set(all_) - set(kept):
            fs.delete(self._path("published", f"{v:012d}.json"), False)
        for s in fs.listStatus(self._path("published")) if fs.exists(self._path("published")) else []:
            if s.getPath().getName().startswith("_"):
                fs.delete(s.getPath(), False)
        gone = []
        for s in fs.listStatus(self._path("data")) if fs.exists(self._path("data")) else []:
            if s.getPath().getName() not in named:
                fs.delete(s.getPath(), True)
                gone.append(s.getPath().getName())
        return sorted(gone)
