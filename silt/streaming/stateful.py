"""Structured Streaming twins: running moments, pairing, ticks. State is a few numbers a key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or folder as a stream, with the batch schema; a folder may be named like a file."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder or ".")


def changed_files(spark: SparkSession, folder: str, pattern: str = "*", at_once: int | None = None) -> DataFrame:
    """(path, modified) of files as they come or change, each once a modification; ``at_once`` bounds a batch."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern)
    reader = reader.option("maxFilesPerTrigger", at_once) if at_once else reader
    return reader.load(folder).select("path", F.col("modificationTime").alias("modified"))


class Moments(StatefulProcessor):
    """Count, mean and sum of squares of each key, updated batch by batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("moments", "n long, mean double, m2 double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        n, mean, m2 = self.state.get() if self.state.exists() else (0, 0.0, 0.0)
        for part in rows:
            x = part["x"].dropna()
            k = len(x)
            if k:
                m, d = float(x.mean()), float(x.mean()) - mean
                m2 += float(((x - m) ** 2).sum()) + d * d * n * k / (n + k)
                n, mean = n + k, mean + d * k / (n + k)
        self.state.update((n, mean, m2))
        yield pd.DataFrame({"key": [key[0]], "n": [n], "mean": [mean], "sd": [(max(m2, 0.0) / n) ** 0.5 if n else 0.0]})

    def close(self) -> None:
        pass


class Pairs(StatefulProcessor):
    """The opening row of each key waits for its closing row; a closing row without one passes through."""

    def __init__(self, opens: str, closes: str):
        self.opens, self.closes = opens, closes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("open", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        waiting = self.state.get()[0] if self.state.exists() else None
        out = []
        for kind, at in pd.concat(list(rows)).sort_values("at")[["kind", "at"]].itertuples(index=False):
            if kind == self.opens:
                waiting = int(at)
            elif kind == self.closes:
                out.append((key[0], waiting, int(at)))
                waiting = None
        if waiting is None:
            self.state.clear()
        else:
            self.state.update((waiting,))
        yield pd.DataFrame({"key": [o[0] for o in out], "opened": pd.array([o[1] for o in out], "Int64"), "closed": pd.array([o[2] for o in out], "Int64")})

    def close(self) -> None:
        pass


class Growth(StatefulProcessor):
    """Gives up on a key once its value has stayed as it was for so many rows; a later change starts anew."""

    def __init__(self, least: int):
        self.least = least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("growth", "last string, waits long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        last, waits = self.state.get() if self.state.exists() else (None, -1)
        out = []
        for at, value in pd.concat(list(rows)).sort_values("at")[["at", "value"]].itertuples(index=False):
            waits = waits + 1 if waits >= 0 and value == last else 0
            last = value
            if waits == self.least:
                out.append((key[0], int(at)))
        self.state.update((last, waits))
        yield pd.DataFrame({"key": [o[0] for o in out], "at": pd.array([o[1] for o in out], "Int64")})

    def close(self) -> None:
        pass


class Rate(StatefulProcessor):
    """Amount a second since a key's first row, shown at most once in ``every_ms``; rows before ``from_ms`` show nothing but hold the next ones back."""

    def __init__(self, every_ms: int, from_ms: int):
        self.every_ms, self.from_ms = every_ms, from_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("rate", "start long, shown long, amount long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        start, shown, total = self.state.get() if self.state.exists() else (None, None, 0)
        out = []
        for at, amount in pd.concat(list(rows)).sort_values("at")[["at", "amount"]].itertuples(index=False):
            at, total = int(at), total + int(amount)
            start = at if start is None else start
            if shown is None or at - shown >= self.every_ms:
                shown = at
                if total > 0 and at - start >= self.from_ms:
                    out.append((key[0], at, int(total * 1000 / (at - start) + 0.5)))
        self.state.update((start, shown, total))
        yield pd.DataFrame({"key": [o[0] for o in out], "at_ms": pd.array([o[1] for o in out], "Int64"), "rate": pd.array([o[2] for o in out], "Int64")})

    def close(self) -> None:
        pass


def growth(stream: DataFrame, key: str, at: str, value: str, least: int) -> DataFrame:
    """(key, at): where a key's value had stayed as it was for ``least`` rows."""
    rows = stream.select(F.col(key).alias("key"), F.col(at).cast("long").alias("at"), F.col(value).cast("string").alias("value"))
    return rows.groupBy("key").transformWithStateInPandas(Growth(least), f"key {rows.schema['key'].dataType.simpleString()}, at long", "Append", "None")


def rates(stream: DataFrame, key: str, at_ms: str, amount: str, every_ms: int = 250, from_ms: int = 100) -> DataFrame:
    """(key, at_ms, rate) as they come."""
    rows = stream.select(F.col(key).alias("key"), F.col(at_ms).cast("long").alias("at"), F.col(amount).cast("long").alias("amount")).dropna()
    return rows.groupBy("key").transformWithStateInPandas(Rate(every_ms, from_ms), f"key {rows.schema['key'].dataType.simpleString()}, at_ms long, rate long", "Append", "None")


def tagged(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("out", "err")) -> DataFrame:
    """Two streams as one, each row marked; their order is that of arrival."""
    return a.withColumn("stream", F.lit(names[0])).unionByName(b.withColumn("stream", F.lit(names[1])))


def moments(stream: DataFrame, key: str, x: str) -> DataFrame:
    return stream.select(F.col(key).alias("key"), F.col(x).alias("x")).groupBy("key").transformWithStateInPandas(Moments(), "key string, n long, mean double, sd double", "Update", "None")


def pairs(stream: DataFrame, key: str, kind: str, at: str, opens: str, closes: str) -> DataFrame:
    kinds = stream.schema[key].dataType.simpleString()
    rows = stream.filter(F.col(kind).isin(opens, closes)).select(F.col(key).alias("key"), F.col(kind).alias("kind"), F.col(at).cast("long").alias("at"))
    return rows.groupBy("key").transformWithStateInPandas(Pairs(opens, closes), f"key {kinds}, opened long, closed long", "Append", "None")


def ticks(stream: DataFrame, at: str, key: str, counter: str, every: str, late: str = "10 minutes") -> DataFrame:
    """The last counter of each period and key, once the watermark has passed it."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, every).alias("w"), key).agg(F.max_by(counter, at).alias("last"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "last", "n")


def run_once(df: DataFrame, mode: str, checkpoint: str, sink: str) -> DataFrame:
    """Run a stream over what is there and give what it wrote; batches are files in the shared folder. Without any batch there are no rows."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        put = lambda rows, batch: rows.withColumn("batch_", F.lit(batch)).write.mode("append").parquet(sink)
        q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        if before:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    schema, at = StructType([*df.schema.fields, StructField("batch_", IntegerType())]), spark._jvm.org.apache.hadoop.fs.Path(sink)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(sink)
