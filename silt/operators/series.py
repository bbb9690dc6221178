"""Ordered series: gaps, rates of counters, shares, running statistics, runs. Windows are always partitioned by entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from silt.operators import fold


def by(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def so_far(keys: Sequence[str], order: Sequence[str]):
    return by(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def gaps(df: DataFrame, keys: Sequence[str], order: Sequence[str], micros: Column) -> DataFrame:
    """Microseconds since the row before; the first row of an entity has none."""
    return df.withColumn("gap_us", micros - F.lag(micros).over(by(keys, order)))


def counter_rate(df: DataFrame, keys: Sequence[str], order: Sequence[str], counter: str, micros: Column, factor: float = 1.0, largest: int | None = None) -> DataFrame:
    """(counter - previous) * factor / elapsed; a negative difference has wrapped at ``largest``, or is dropped without it."""
    w = by(keys, order)
    diff = F.col(counter) - F.lag(counter).over(w)
    wrapped = F.when(diff < 0, diff + largest + 1 if largest is not None else None).otherwise(diff)
    return df.withColumn("_d", wrapped).withColumn("_s", (micros - F.lag(micros).over(w)) / 1e6).withColumn("rate", F.when(F.col("_s") > 0, F.col("_d") * factor / F.col("_s"))).drop("_d", "_s")


def shares(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """100 value / total of the group; 0 where the total is not positive."""
    total = F.sum(value).over(Window.partitionBy(*group))
    return df.withColumn("share_pct", F.when(total > 0, 100.0 * F.col(value) / total).otherwise(F.lit(0.0)))


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str) -> DataFrame:
    return df.withColumn("running_total", F.sum(x).over(so_far(keys, order)))


def running_stats(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, from_row: int = 3) -> DataFrame:
    """Running mean and population deviation, from the third row of an entity on."""
    w = so_far(keys, order)
    return df.withColumn("n", F.count(x).over(w)).withColumn("mean", F.avg(x).over(w)).withColumn("sd", F.stddev_pop(x).over(w)).filter(F.col("n") >= from_row)


def changes(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value differs from the row before: consecutive repeats are dropped."""
    prev = F.lag(value).over(by(keys, order))
    return df.withColumn("_p", prev).filter(~F.col(value).eqNullSafe(F.col("_p"))).drop("_p")


def late_ticks(df: DataFrame, keys: Sequence[str], order: Sequence[str], micros: Column, period_us: int) -> DataFrame:
    """Rows that came over a period after the row before, with the number of ticks missed."""
    g = gaps(df, keys, order, micros)
    return g.filter(F.col("gap_us") > period_us).withColumn("missed", F.floor(F.col("gap_us") / period_us).cast("long"))


def last_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The last n rows; a top-k, so no global sort."""
    return df.orderBy(*order).limit(n)


def merged(a: DataFrame, b: DataFrame, order: Sequence[str], names: tuple[str, str] = ("out", "err")) -> DataFrame:
    """Two streams as one, marked, in time order; ties keep the first stream first."""
    both = a.withColumn("stream", F.lit(names[0])).unionByName(b.withColumn("stream", F.lit(names[1])))
    rank = F.when(F.col("stream") == names[0], 0).otherwise(1)
    return both.withColumn("_r", rank).orderBy(order[0], "_r", *order[1:]).drop("_r")


def paired(df: DataFrame, keys: Sequence[str], order: Sequence[str], kind: str, opens: str, closes: str, value: str) -> DataFrame:
    """Each opening row with the next closing row of its entity, if no other opening row comes between."""
    w = by(keys, order)
    rows = df.filter(F.col(kind).isin(opens, closes)).withColumn("_k", F.lead(kind).over(w)).withColumn("closed_by", F.lead(value).over(w)).withColumn("closed_at", F.lead(order[0]).over(w))
    return rows.filter((F.col(kind) == opens) & (F.col("_k") == closes)).drop("_k")


def line_pairs(df: DataFrame, keys: Sequence[str], order: Sequence[str], line: str, separator: str = " ") -> DataFrame:
    """(keys, pair, joined): each two adjacent lines as one; an odd last line stands alone."""
    pair = F.floor((F.row_number().over(by(keys, order)) - 1) / 2).cast("long")
    rows = df.withColumn("pair", pair).withColumn("_at", F.row_number().over(by(keys, order)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", line))), lambda r: r[line]), separator)
    return rows.groupBy(*keys, "pair").agg(joined.alias("joined"))


def speeds(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: str) -> DataFrame:
    """``speed``, what the size grew by since the row before, and ``mean_speed`` so far; the first row of an entity has neither."""
    grown = df.withColumn("speed", F.col(size) - F.lag(size).over(by(keys, order)))
    return grown.withColumn("mean_speed", F.avg("speed").over(so_far(keys, order)))


def stalls(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, least: int) -> DataFrame:
    """(keys, start, waits): runs in which the value stayed as it was for ``least`` rows or more; start is the first column of ``order`` where it began."""
    w = by(keys, order)
    moved = (F.row_number().over(w) == 1) | ~F.col(value).eqNullSafe(F.lag(value).over(w))
    runs = df.withColumn("_m", moved.cast("long")).withColumn("_run", F.sum("_m").over(so_far(keys, order)))
    return runs.groupBy(*keys, "_run").agg(F.min(order[0]).alias("start"), (F.count("*") - 1).alias("waits")).filter(F.col("waits") >= least).drop("_run")


def rate_since_start(df: DataFrame, keys: Sequence[str], order: Sequence[str], counter: str, micros: Column, started: Column, factor: float = 1.0) -> DataFrame:
    """Rates of a counter that was 0 at ``started`` (microseconds): the first row of an entity is the average since then."""
    w = by(keys, order)
    grown = F.col(counter) - F.coalesce(F.lag(counter).over(w), F.lit(0))
    elapsed = (micros - F.coalesce(F.lag(micros).over(w), started)) / 1e6
    return df.withColumn("_d", grown).withColumn("_s", elapsed).withColumn("rate", F.when(F.col("_s") > 0, F.col("_d") * factor / F.col("_s"))).drop("_d", "_s")


def progress_steps(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows at which an entity's progress reaches another whole percent, with ``percent``."""
    done = F.floor(100 * F.row_number().over(by(keys, order)) / F.count("*").over(Window.partitionBy(*keys)))
    rows = df.withColumn("percent", done.cast("long"))
    before = F.coalesce(F.lag("percent").over(by(keys, order)), F.lit(0))
    return rows.withColumn("_b", before).filter("percent > _b").drop("_b")


def throttled_rates(df: DataFrame, key: str, at_ms: str, amount: str, every_ms: int = 250, from_ms: int = 100) -> DataFrame:
    """(key, at_ms, rate): amount a second since the key's first row, shown at most once in ``every_ms``.

    What is shown depends on what was shown before, so a key's rows are walked in order; two times are remembered. Rows without
    amount, or before ``from_ms``, show nothing but still hold the next ones back.
    """

    def step(state, row):
        at, n = row
        start, shown = state or (at, None)
        if shown is not None and at - shown < every_ms:
            return (start, shown), []
        return (start, at), [(at, int(n * 1000 / (at - start) + 0.5))] if n > 0 and at - start >= from_ms else []

    rows = df.select(F.col(key).alias("key"), at_ms, amount).dropna()
    return fold.folded(rows, ["key"], [F.col(at_ms), F.col(amount)], [at_ms, amount], step, "at_ms long, rate long")
