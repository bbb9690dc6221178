"""What the operators share: shared-folder tables, Arrow mapping, word hashing, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silt.operators import graph, shared

#: Texts handled at once inside an Arrow batch, and the characters after which a slice is cut early.
SLICE_ROWS, SLICE_CHARS = 256, 2_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors lose nothing.

    ``by`` names a column whose values have folders of their own.
    """
    spark = df.sparkSession
    path = f"{shared.root(spark)}/silt-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.silt_path_ = path
    return back


def discard(df: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.silt_path_)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Keys with over one in HOT of all uses, and over FEW (in a small table over a thousandth of all), count as hot: there are fewer
#: than HOT of them, so they may be broadcast. A key that only one row meets never does, so what comes with it is not sent.
HOT, FEW = 100_000, 1000


def joined_by_weight(rows: DataFrame, keys: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner, left or left_semi) with ``keys``, a stored table of distinct keys whose ``weight`` counts the rows that each meets.

    Rows of hot keys would meet in one task of a shuffled join; they meet a broadcast of fewer than ``HOT`` keys instead.
    """
    total = keys.agg(F.sum(weight)).first()[0] or 0
    most = max(1, total / HOT, min(FEW, total / 1000))
    hot, cold = keys.filter(F.col(weight) > most), keys.filter(F.col(weight) <= most)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on, "inner" if how == "left" else how).unionByName(rest.join(cold, on, how))


def bounded_sample(df: DataFrame, key: str, n: int, total: int) -> DataFrame:
    """At most ``n`` rows of ``df``, those of the least key hashes; ``total`` is the number of its rows, or more.

    A threshold on the hash leaves little over ``n`` rows before they are sorted, so tasks send no more than these.
    """
    h = F.xxhash64(F.lit(17), key)
    share = min(1.0, (1.1 * n + 4 * n**0.5 + 10) / max(total, 1))
    return df.filter(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.pmod(h, F.lit(1 << 30)), key).limit(n)


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts that are small enough to be worked on together."""
    start = chars = 0
    for i, text in enumerate(texts):
        chars += len(text)
        if i + 1 - start >= SLICE_ROWS or chars >= SLICE_CHARS:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def map_texts(df: DataFrame, keep: list[str], text: str, fn: Callable[[list[str]], dict[str, list]], fields: dict[str, pa.DataType], schema: str) -> DataFrame:
    """Columns ``keep`` plus what ``fn`` makes of each text (null: empty); ``fn`` gets a slice of texts and returns lists or Arrow arrays of that length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, SLICE_ROWS) for i in range(0, whole.num_rows, SLICE_ROWS)):
                yield from sliced(batch)

    def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
        for a, b in slices(texts):
            out = fn(texts[a:b])
            cols = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(cols + [out[k] if isinstance(out[k], pa.Array) else pa.array(out[k], t) for k, t in fields.items()], names=[*keep, *fields])

    return df.select(*keep, text).mapInArrow(run, schema)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows, one or more, as a batch."""
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class WordHash(dict):
    """word -> 64-bit hash, the same on every machine; forgets all once it holds too many."""

    LIMIT = 150_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform doubles in (0, 1] from 64-bit hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; a shorter text is one run of all its words."""
    if len(words) == 0:
        return words
    n = max(1, len(words) - size + 1)
    h = np.full(n, np.uint64(0x243F6A8885A308D3))
    for i in range(min(size, len(words))):
        h = mix64(h * MIX + words[i : i + n])
    return h


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root): the least node of each connected component, for every node that has an edge (a, b); rounds are stored tables."""
    return graph.components(edges, lambda df: stored(df, label), discard).withColumnRenamed("component", "root")
