"""Similarity lookup under any distance that a caller gives, by a stored index of distances to pivots.

The distance has to be a metric (of whole or real numbers), as an expression of two columns: built in, or a vectorised
function of the caller's. Pivots are a few values that lie far apart in a bounded sample. Every distinct value is stored
with its distances to the pivots. By the triangle inequality two values within a radius differ by no more than it in their
distance to any pivot, so a query meets only values in its own or a neighbouring bucket of the first pivots' distances, is
then compared on the distances to all pivots, and only what is left is measured. Nothing is lost, whatever the pivots.

Distances of long random codes to any pivot are much alike, so their buckets hold nearly everything. For such a metric a caller
gives ``keys``, of which two values within a radius share one at least: values then meet by these instead of by buckets.

Null values are not indexed and null queries find nothing; equal values are one entry. An empty index finds nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silt.operators import similarity

Distance = Callable[[Column, Column], Column]
#: (radius) -> (keys of a query, keys of a value): arrays of one type; what is within the radius has a key in common.
Keys = Callable[[float], tuple[Callable[[Column], Column], Callable[[Column], Column]]]

#: Values of the sample that pivots are chosen from.
SAMPLE = 2000


def chosen_pivots(values: DataFrame, value: str, distance: Distance, n: int, sample: int = SAMPLE) -> list:
    """``n`` values of a sample (those of the least hashes), each as far as can be from those before it."""
    some = values.orderBy(F.xxhash64(value), value).limit(sample).select(F.col(value).alias("v"))
    rows = [r.v for r in some.collect()]
    if not rows:
        return []
    pivots, nearest = [rows[0]], dict.fromkeys(rows, float("inf"))
    while len(pivots) < min(n, len(rows)):
        for r in some.select("v", distance(F.col("v"), F.lit(pivots[-1])).cast("double").alias("d")).collect():
            nearest[r.v] = min(nearest[r.v], r.d)
        pivots.append(max(rows, key=lambda v: (nearest[v], str(v))))
    return pivots


@dataclass
class PivotIndex:
    """(value, d: distances to the pivots) of distinct values."""

    entries: DataFrame
    pivots: list
    distance: Distance
    keys: Keys | None = None

    @staticmethod
    def of(df: DataFrame, value: str, distance: Distance, pivots: int = 4, keys: Keys | None = None) -> PivotIndex:
        values = df.filter(F.col(value).isNotNull()).select(F.col(value).alias("value")).distinct()
        chosen = chosen_pivots(values, "value", distance, pivots)
        return PivotIndex(measured(values, chosen, distance), chosen, distance, keys)

    def save(self, path: str) -> None:
        """Entries and pivots as tables below a folder."""
        self.entries.write.parquet(f"{path}/entries")
        kind = self.entries.schema["value"].dataType.simpleString()
        self.entries.sparkSession.createDataFrame(list(enumerate(self.pivots)), f"n int, value {kind}").coalesce(1).write.parquet(f"{path}/pivots")

    @staticmethod
    def load(spark: SparkSession, path: str, distance: Distance, keys: Keys | None = None) -> PivotIndex:
        """A saved index; ``distance`` must be the one that it was made with."""
        pivots = [r.value for r in spark.read.parquet(f"{path}/pivots").orderBy("n").collect()]
        return PivotIndex(spark.read.parquet(f"{path}/entries"), pivots, distance, keys)

    def with_new(self, df: DataFrame, value: str) -> PivotIndex:
        """The index with more values; only these are measured."""
        new = df.filter(F.col(value).isNotNull()).select(F.col(value).alias("value")).distinct().join(self.entries.select("value"), "value", "left_anti")
        return PivotIndex(self.entries.unionByName(measured(new, self.pivots, self.distance)), self.pivots, self.distance, self.keys)

    def candidates(self, queries: DataFrame, query: str, radius: float, keyed: int = 2) -> DataFrame:
        """(query, value): pairs that distances to the pivots do not rule out; ``keyed`` of them are met by equality."""
        asked = queries.filter(F.col(query).isNotNull()).select(F.col(query).alias("query")).distinct()
        asked = measured(asked, self.pivots, self.distance, "query").withColumnRenamed("d", "q")
        near = [F.abs(F.col("q")[i] - F.col("d")[i]) <= radius for i in range(len(self.pivots))]
        if self.keys:
            of_query, of_value = self.keys(radius)
            n = max(2, int(self.entries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
            left = asked.withColumn("key", F.explode(of_query(F.col("query")))).repartition(n, "key")
            right = self.entries.select("value", "d", F.explode(of_value(F.col("value"))).alias("key")).repartition(n, "key")
            return left.join(right, "key").filter(reduce(lambda x, y: x & y, near)).select("query", "value").distinct()
        width, keyed = radius if radius > 0 else 1, min(keyed, len(self.pivots))
        bucket = lambda c: F.floor(c / F.lit(width)).cast("long")
        held = self.entries.select("value", "d", *[bucket(F.col("d")[i]).alias(f"b{i}") for i in range(keyed)])
        for i in range(keyed):
            b = bucket(F.col("q")[i])
            asked = asked.withColumn(f"b{i}", F.explode(F.array(b - 1, b, b + 1)))
        met = asked.join(held, [f"b{i}" for i in range(keyed)])
        return met.filter(reduce(lambda x, y: x & y, near)).select("query", "value")

    def within(self, queries: DataFrame, query: str, radius: float) -> DataFrame:
        """(query, value, distance) of all values within ``radius`` of each distinct query."""
        if not self.pivots:
            return self.entries.limit(0).select(F.col("value").alias("query"), "value", self.distance(F.col("value"), F.col("value")).alias("distance"))
        return self.candidates(queries, query, radius).withColumn("distance", self.distance(F.col("query"), F.col("value"))).filter(F.col("distance") <= radius)

    def kept_share(self, queries: DataFrame, query: str, radius: float) -> float:
        """Which share of all pairs has to be measured."""
        n = queries.filter(F.col(query).isNotNull()).select(query).distinct().count() * self.entries.count()
        return self.candidates(queries, query, radius).count() / n if n else 0.0


def measured(values: DataFrame, pivots: list, distance: Distance, value: str = "value") -> DataFrame:
    """``value`` with ``d``, its distances to the pivots."""
    each = [distance(F.col(value), F.lit(p)).cast("double") for p in pivots]
    return values.select(value, (F.array(*each) if each else F.array().cast("array<double>")).alias("d"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit numbers."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming_keys(radius: float) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """(band, its bits) of values, and of queries with all masks of the band's radius."""
    bands = similarity.bit_bands(2**64 - 1, int(radius), int(radius) // 3 + 1)

    def masked(h: Column, i: int) -> Callable[[Column], Column]:
        return lambda m: F.struct(F.lit(i).alias("band"), similarity.within_band(h, bands[i][0]).bitwiseXOR(m).alias("bits"))

    def of_query(h: Column) -> Column:
        return F.flatten(F.array(*[F.transform(similarity.longs(similarity.flips(*b)), masked(h, i)) for i, b in enumerate(bands)]))

    return of_query, lambda h: F.array(*[masked(h, i)(F.lit(0).cast("long")) for i in range(len(bands))])


def edits(a: Column, b: Column) -> Column:
    """Levenshtein distance."""
    return F.levenshtein(a, b)
