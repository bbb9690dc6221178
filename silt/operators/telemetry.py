"""Metric views over long-form counters (entity, counters, time): discovery, totals, rates, and a registry of named views."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from importlib import import_module

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

View = Callable[[DataFrame], DataFrame]


@dataclass
class Views:
    """Named views; a view is a function from frame to frame and may name columns that it needs."""

    views: dict[str, tuple[View, tuple[str, ...]]] = field(default_factory=dict)
    instead: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def register(self, name: str, needs: Sequence[str] = (), instead: Sequence[str] = ()) -> Callable[[View], View]:
        """Decorator; ``instead`` names views to try, in order, where the frame lacks what this one needs."""

        def put(view: View) -> View:
            if name in self.views:
                raise ValueError(f"duplicate view {name}")
            self.views[name] = (view, tuple(needs))
            self.instead[name] = tuple(instead)
            return view

        return put

    def load(self, modules: Sequence[str]) -> None:
        """Views of other modules: each is imported, and its ``register(views)`` called."""
        for module in modules:
            import_module(module).register(self)

    def chosen(self, name: str, columns: Sequence[str]) -> str:
        """The first of ``name`` and its stand-ins that the columns allow."""
        for candidate in (name, *self.instead.get(name, ())):
            if candidate in self.views and set(self.views[candidate][1]) <= set(columns):
                return candidate
        raise LookupError(f"no view {name} for these columns")

    def show(self, df: DataFrame, name: str) -> DataFrame:
        return self.views[self.chosen(name, df.columns)][0](df)


def active(df: DataFrame, counters: Sequence[str]) -> DataFrame:
    """Rows with a counter that is neither 0 nor null: idle entities go."""
    return df.filter(reduce(lambda a, b: a | b, [F.coalesce(F.col(c) != 0, F.lit(False)) for c in counters]))


def discovered(df: DataFrame, entity: str, more_than: int) -> DataFrame:
    """(entity, seen) of those that occur more than so many times."""
    return df.groupBy(entity).agg(F.count("*").alias("seen")).filter(F.col("seen") > more_than)


def totals(df: DataFrame, keys: Sequence[str], entity: str, counters: Sequence[str], leave_out: str) -> DataFrame:
    """Sums over the entities that the whole pattern does not fit (partitions, virtual devices); keys with none of these have 0."""
    counted = ~F.coalesce(F.col(entity).rlike(f"^(?:{leave_out})$"), F.lit(False))
    return df.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(counted, F.col(c))), F.lit(0)).alias(c) for c in counters])


def with_overall(df: DataFrame, key: str, value: str, overall: str = "total") -> DataFrame:
    """Sums by key and over all, without those of 0."""
    sums = df.groupBy(key).agg(F.sum(value).alias(value)).filter(F.col(value) != 0).withColumn(key, F.col(key).cast("string"))
    return sums.unionByName(sums.agg(F.sum(value).alias(value)).withColumn(key, F.lit(overall)))


def used_memory(total: Column, free: Column, buffers: Column, cached: Column, reclaimable: Column, shared: Column) -> Column:
    return total - free - buffers - cached - reclaimable + shared


def tuple_rates(before: Column, now: Column, elapsed: Column, factor: float = 1.0) -> Column:
    """Element by element, what each counter grew by a second."""
    return F.zip_with(before, now, lambda a, b: F.when(elapsed > 0, (b - a) * factor / elapsed))


def baseline_rates(df: DataFrame, keys: Sequence[str], order: Sequence[str], counter: str, seconds: Column, period: int) -> DataFrame:
    """Rates against the last row of the period before: rows inside a period share that baseline until it closes.

    Periods are ``period`` seconds; rows of an entity's first period have no baseline and no rate.
    """
    rows = df.withColumn("_t", seconds).withColumn("_p", F.floor(F.col("_t") / period))
    earlier = Window.partitionBy(*keys).orderBy("_p").rangeBetween(Window.unboundedPreceding, -1)
    last = F.max(F.struct("_p", *order, F.col(counter).alias("_c"), F.col("_t").alias("_s"))).over(earlier)
    based = rows.withColumn("_b", last)
    elapsed = F.col("_t") - F.col("_b._s")
    return based.withColumn("rate", F.when(elapsed > 0, (F.col(counter) - F.col("_b._c")) / elapsed)).drop("_t", "_p", "_b")


def csv_lines(df: DataFrame, order: Sequence[str], groups: Sequence[tuple[str, Sequence[str]]], about: Sequence[str]) -> DataFrame:
    """(part, at, line) of a telemetry file: 0 what it is about, 1 groups, 2 names, 3 a line for each row, in ``order``.

    A writer sorts by part, then at; lines of part 3 are ordered by the first ordering column.
    """
    quoted = lambda s: '"' + s.replace('"', '""') + '"'
    first = ",".join(quoted(g) + "," * (len(names) - 1) for g, names in groups)
    second = ",".join(quoted(n) for _, names in groups for n in names)
    head = [*((0, i, quoted(a)) for i, a in enumerate(about)), (1, 0, first), (2, 0, second)]
    at = F.col(order[0]).cast("long")
    rows = df.select(F.lit(3).alias("part"), at.alias("at"), F.concat_ws(",", *[F.coalesce(F.col(n).cast("string"), F.lit("")) for _, names in groups for n in names]).alias("line"))
    return df.sparkSession.createDataFrame(head, "part int, at long, line string").unionByName(rows)
