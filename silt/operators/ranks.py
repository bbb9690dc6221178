"""Values at given ranks of a key, exactly, however many values the key has.

Equal values are counted before the shuffle. What is left is range-partitioned by key and value, so a key with very many
values lies in many tasks, each in order. Tasks then tell how many rows each key has in them; the sums of the tasks before
(a row for each key and task that meet) turn counts inside a task into ranks, and only values whose ranks are asked for
go on. No task holds all values of a key, and nothing is collected.

Nulls are left out. Keys without values give no rows. Null keys are a key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from silt.operators import graph

#: Keys whose medians, a row each, are sent to all tasks; the rows of more keys are shuffled.
FEW = 10_000


def ranked(df: DataFrame, keys: Sequence[str], x: str, cut: Callable[[DataFrame], DataFrame] = graph._cut) -> DataFrame:
    """``keys``, ``x``, ``first_``, ``last_`` and ``n_``: each distinct value with its first and last rank from 1, and the key's rows."""
    counts = df.filter(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("c_"))
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = cut(counts.repartitionByRange(n, *keys, x).sortWithinPartitions(*keys, x).withColumn("part_", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy(*keys, "part_").agg(F.sum("c_").alias("s_"))
    sums = sums.withColumns({"skip_": F.coalesce(F.sum("s_").over(before), F.lit(0)), "n_": F.sum("s_").over(Window.partitionBy(*keys))}).drop("s_")
    inside = Window.partitionBy(*keys, "part_").orderBy(x).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = parts.withColumn("upto_", F.sum("c_").over(inside))
    on = [upto[k].eqNullSafe(sums[k]) for k in [*keys, "part_"]]
    both = upto.join(sums, on).select(*[upto[k] for k in keys], upto[x], (F.col("skip_") + F.col("upto_") - F.col("c_") + 1).alias("first_"), (F.col("skip_") + F.col("upto_")).alias("last_"), "n_")
    return both


def at_ranks(df: DataFrame, keys: Sequence[str], x: str, wanted: dict[str, Callable[[Column], Column]], cut: Callable[[DataFrame], DataFrame] = graph._cut) -> DataFrame:
    """``keys``, ``n_`` and, for each name in ``wanted``, the value at the rank that its function makes of the key's number of rows."""
    rows = ranked(df, keys, x, cut)
    hit = {name: (F.col("first_") <= rank(F.col("n_"))) & (rank(F.col("n_")) <= F.col("last_")) for name, rank in wanted.items()}
    some = F.lit(False)
    for h in hit.values():
        some = some | h
    return rows.filter(some).groupBy(*keys).agg(F.max("n_").alias("n_"), *[F.max(F.when(h, F.col(x))).alias(name) for name, h in hit.items()])


def nearest_ranks(df: DataFrame, keys: Sequence[str], x: str, ps: Sequence[int]) -> DataFrame:
    """``keys``, p, value: the value at rank ceil(n p / 100), a row for each p."""
    rank = lambda p: lambda n: F.greatest(F.lit(1), F.ceil(n * p / F.lit(100)))
    got = at_ranks(df, keys, x, {f"p{p}_": rank(p) for p in ps})
    return got.select(*keys, F.inline(F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"p{p}_").alias("value")) for p in ps])))


def interpolated(df: DataFrame, keys: Sequence[str], x: str, ps: Sequence[float]) -> DataFrame:
    """``keys``, p, value: linear interpolation at p (n - 1) + 1."""
    at = lambda p, n: F.lit(p) * (n - 1)
    low = lambda p: lambda n: F.floor(at(p, n)) + 1
    high = lambda p: lambda n: F.ceil(at(p, n)) + 1
    got = at_ranks(df, keys, x, {f"{side}{i}_": f(p) for i, p in enumerate(ps) for side, f in (("a", low), ("b", high))})
    part = lambda p: at(p, F.col("n_")) - F.floor(at(p, F.col("n_")))
    value = lambda i, p: F.col(f"a{i}_") + (F.col(f"b{i}_") - F.col(f"a{i}_")) * part(p)
    return got.select(*keys, F.inline(F.array(*[F.struct(F.lit(p).alias("p"), value(i, p).alias("value")) for i, p in enumerate(ps)])))


def medians(df: DataFrame, keys: Sequence[str], x: str, name: str = "median") -> DataFrame:
    """``keys`` and the median: the middle value, or the mean of the two middle ones."""
    got = at_ranks(df, keys, x, {"a_": lambda n: F.floor((n + 1) / 2), "b_": lambda n: F.floor(n / 2) + 1})
    return got.select(*keys, ((F.col("a_") + F.col("b_")) / 2).alias(name))


def mad_outliers(df: DataFrame, keys: Sequence[str], x: str, above: float = 3.5, cut: Callable[[DataFrame], DataFrame] = graph._cut) -> DataFrame:
    """Rows whose modified z-score 0.6745 |x - median| / MAD exceeds ``above``; where MAD is 0, all rows off the median. The two medians are exact and held in no task."""

    def joined(rows: DataFrame, other: DataFrame) -> DataFrame:
        own = cut(other.withColumnsRenamed({k: f"{k}_k_" for k in keys}))
        own = F.broadcast(own) if own.limit(FEW + 1).count() <= FEW else own  # with few keys, sorted rows of one would fill a task
        return rows.join(own, [F.col(k).eqNullSafe(F.col(f"{k}_k_")) for k in keys]).drop(*[f"{k}_k_" for k in keys])

    mid = medians(df, keys, x, "med_")
    off = joined(df, mid).withColumn("off_", F.abs(F.col(x) - F.col("med_")))
    mad = medians(off, keys, "off_", "mad_")
    far = F.when(F.col("mad_") == 0, F.col("off_") > 0).otherwise(F.lit(0.6745) * F.col("off_") / F.col("mad_") > above)
    return joined(off, mad).filter(far).select(*df.columns)
