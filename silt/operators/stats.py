"""Descriptive statistics, percentiles, outliers and histograms; partial aggregates throughout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def summary(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """n, mean, population and sample deviation (0 for one row), median, min, max and CV%, of the sample deviation (0 unless the total is positive)."""
    sd = F.coalesce(F.stddev_samp(x), F.lit(0.0))
    cv = F.when(F.sum(x) > 0, 100 * sd / F.avg(x)).otherwise(F.lit(0.0))
    return df.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd_pop"), sd.alias("sd_samp"),
        F.median(x).alias("median"), F.min(x).alias("min"), F.max(x).alias("max"), cv.alias("cv_pct"),
    )


def percentiles_by_rank(df: DataFrame, keys: Sequence[str], x: str, ps: Sequence[int]) -> DataFrame:
    """The value at rank ceil(n p / 100), a row for each p. Equal values are counted before the shuffle; counts are ranked, not rows."""
    counts = df.filter(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.withColumn("_upto", upto).withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
    wide = ranked.groupBy(*keys).agg(*[F.min(F.when(F.col("_upto") * 100 >= F.col("_n") * p, F.col(x))).alias(f"p{p}") for p in ps])
    return wide.select(*keys, F.inline(F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"p{p}").alias("value")) for p in ps])))


def percentiles_interpolated(df: DataFrame, keys: Sequence[str], x: str, ps: Sequence[float]) -> DataFrame:
    """Linear interpolation between ranks."""
    values = F.percentile(x, F.array(*[F.lit(p) for p in ps]))
    got = df.groupBy(*keys).agg(values.alias("_v"))
    return got.select(*keys, F.inline(F.arrays_zip(F.array(*[F.lit(p) for p in ps]).alias("p"), F.col("_v").alias("value"))))


def percentile_exclusive(df: DataFrame, keys: Sequence[str], x: str, p: float) -> DataFrame:
    """The exclusive method: the value at p (n + 1), interpolated, between the ends. Counts of equal values are ranked, not rows."""
    counts = df.filter(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    n = F.sum("_c").over(Window.partitionBy(*keys))
    pos = F.lit(p) * (F.col("_n") + 1)
    low = F.greatest(F.lit(1), F.least(F.floor(pos), F.col("_n") - 1))
    ranked = counts.withColumn("_upto", upto).withColumn("_n", n).withColumn("_low", low).withColumn("_part", F.least(F.lit(1.0), F.greatest(F.lit(0.0), pos - F.col("_low"))))
    at = lambda k: F.min(F.when(F.col("_upto") >= k, F.col(x)))
    ends = ranked.groupBy(*keys).agg(at(F.col("_low")).alias("_a"), at(F.least(F.col("_low") + 1, F.col("_n"))).alias("_b"), F.max(F.when(F.col("_n") > 1, F.col("_part")).otherwise(F.lit(0.0))).alias("_w"))
    return ends.select(*keys, (F.col("_a") * (1 - F.col("_w")) + F.col("_b") * F.col("_w")).alias("value"))


def mad_outliers(df: DataFrame, keys: Sequence[str], x: str, above: float = 3.5) -> DataFrame:
    """Rows whose modified z-score 0.6745 |x - median| / MAD exceeds ``above``; where MAD is 0, all rows off the median."""
    med = df.groupBy(*keys).agg(F.median(x).alias("_med"))
    off = df.join(med, list(keys)).withColumn("_off", F.abs(F.col(x) - F.col("_med")))
    mad = off.groupBy(*keys).agg(F.median("_off").alias("_mad"))
    far = F.when(F.col("_mad") == 0, F.col("_off") > 0).otherwise(F.lit(0.6745) * F.col("_off") / F.col("_mad") > above)
    return off.join(mad, list(keys)).filter(far).drop("_med", "_off", "_mad")


def weighted(df: DataFrame, keys: Sequence[str], x: str, w: str) -> DataFrame:
    """Weighted mean and population variance."""
    total = F.sum(w)
    mean = F.sum(F.col(x) * F.col(w)) / total
    return df.groupBy(*keys).agg(total.alias("weight"), mean.alias("mean"), (F.sum(F.col(x) * F.col(x) * F.col(w)) / total - mean * mean).alias("var_pop"))


def _bins(df: DataFrame, bin_of: Column, n: int) -> DataFrame:
    """Counts of bins 1 to n, empty ones too, with their share of what is in range."""
    counts = df.withColumn("bin", bin_of.cast("int")).groupBy("bin").agg(F.count("*").alias("cnt"))
    every = df.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("bin"))
    filled = every.join(counts, "bin", "left").select("bin", F.coalesce("cnt", F.lit(0)).alias("cnt"))
    return filled.withColumn("pct", 100.0 * F.col("cnt") / F.sum("cnt").over(Window.partitionBy(F.lit(1))))  # n rows


def histogram(df: DataFrame, x: str, lo: float, hi: float, n: int, closed: str = "right") -> DataFrame:
    """n equal bins from lo to hi. closed="right": (a, b], with lo in the first; "left": [a, b), with hi in the last."""
    if not hi > lo:
        raise ValueError("the maximum must be above the minimum")
    v, step = F.col(x), (hi - lo) / n
    inside = df.filter((v >= lo) & (v <= hi))
    bin_of = F.greatest(F.lit(1), F.ceil((v - lo) / step)) if closed == "right" else F.least(F.lit(n), F.floor((v - lo) / step) + 1)
    return _bins(inside, bin_of, n)


def histogram_edges(df: DataFrame, x: str, edges: Sequence[float]) -> DataFrame:
    """Bins that end at ``edges``; a value goes to the first edge that is not below it."""
    v = F.col(x)
    bin_of = F.lit(None).cast("int")
    for i in range(len(edges), 0, -1):
        bin_of = F.when(v <= edges[i - 1], i).otherwise(bin_of)
    return _bins(df.withColumn("_b", bin_of).filter("_b IS NOT NULL"), F.col("_b"), len(edges))


def log_edges(lo: float, hi: float, n: int) -> list[float]:
    """Edges of n bins, each twice as wide as the one before."""
    return [lo + (hi - lo) * (2**i - 1) / (2**n - 1) for i in range(1, n + 1)]


def bar(count: Column, mark: str = "=") -> Column:
    return F.repeat(F.lit(mark), count.cast("int"))


def scaled_bars(df: DataFrame, count: str, longest: int = 75, mark: str = "∎") -> DataFrame:
    """``df``, of a few rows, with ``line_bar``: bars of one mark for each so many counts that the longest is at most ``longest``."""
    most = F.max(count).over(Window.partitionBy(F.lit(1)))
    return df.withColumn("_s", F.greatest(F.lit(1), F.ceil(most / longest))).withColumn("line_bar", F.repeat(F.lit(mark), F.floor(F.col(count) / F.col("_s")).cast("int"))).drop("_s")


def slice_sum(values: Column, start: int, length: int) -> Column:
    """The sum of part of an array, from ``start`` (1 is the first)."""
    return F.aggregate(F.slice(values, start, length), F.lit(0.0), lambda s, v: s + v.cast("double"))


def parts_and_rest(df: DataFrame, keys: Sequence[str], kind: str, kinds: Sequence[str]) -> DataFrame:
    """Rows counted by kind, a column for each of ``kinds``, and ``other``, what the total holds beyond them."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("total"), *[F.count_if(F.col(kind) == k).alias(k) for k in kinds])
    return counts.withColumn("other", F.col("total") - sum((F.col(k) for k in kinds), F.lit(0)))
