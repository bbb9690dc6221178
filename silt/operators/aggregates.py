"""Aggregates that a caller defines as three steps: update over rows, merge of states, finish.

The steps work on all keys of a batch at once. Tasks update over their own rows, in Arrow batches, and send one small state a
key (or a few, where a task has very many keys); only states are shuffled, and merged by key. So a key with a third of all
rows sends as many states as there are tasks. Merging must not depend on order.

A state is a row of numbers of fixed width, or of decimals. Null keys are a key of their own; what nulls in the values
mean is the aggregate's matter. A key whose rows are all left out still has the state of no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from decimal import ROUND_HALF_EVEN, Context, Decimal, Inexact

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: States that a task holds before it sends them on.
HELD = 200_000


class Aggregate:
    """The triple. Columns are Arrow arrays; ``group`` numbers each row's (or state's) key from 0 below ``n``."""

    #: Names and SQL types of the state and of the result.
    state: dict[str, str] = {}
    result: dict[str, str] = {}

    def update(self, group: np.ndarray, n: int, *values: pa.Array) -> dict[str, pa.Array | np.ndarray]:
        """A state for each of the ``n`` keys of a batch."""
        raise NotImplementedError

    def merge(self, group: np.ndarray, n: int, states: dict[str, pa.Array]) -> dict[str, pa.Array | np.ndarray]:
        """A state for each key, from all states of these keys."""
        raise NotImplementedError

    def finish(self, states: dict[str, pa.Array]) -> dict[str, pa.Array | np.ndarray]:
        """The results of merged states."""
        raise NotImplementedError


def _group(table: pa.Table, keys: Sequence[str]) -> tuple[np.ndarray, pa.Table]:
    """(number of each row's key, a table of the distinct keys)."""
    total = np.zeros(table.num_rows, np.int64)
    for k in keys:
        codes = table[k].combine_chunks().dictionary_encode(null_encoding="encode")
        codes = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.unique(total * (codes.max(initial=0) + 1) + codes, return_inverse=True)[1]
    _, first, group = np.unique(total, return_index=True, return_inverse=True)
    return group, table.select(list(keys)).take(pa.array(first))


def _equal(column: pa.Array, value: pa.Scalar) -> np.ndarray:
    """Which values are the same key as ``value``: nulls and NaNs are equal to themselves."""
    if not value.is_valid:
        same = pc.is_null(column)
    elif pa.types.is_floating(column.type) and value.as_py() != value.as_py():
        same = pc.is_nan(column)
    else:
        same = pc.equal(column, value)
    return pc.fill_null(same, False).to_numpy(zero_copy_only=False)


def _table(keys: pa.Table, columns: dict, schema: pa.Schema) -> pa.Table:
    data = {f.name: keys[f.name] if f.name in keys.column_names else columns[f.name] for f in schema}
    return pa.table({f.name: (v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v)).cast(f.type) for f, v in zip(schema, data.values(), strict=True)}, schema=schema)


def aggregated(df: DataFrame, keys: Sequence[str], values: Sequence[str], aggregate: Aggregate) -> DataFrame:
    """``keys`` with the columns of ``aggregate.result``, for every combination of keys in ``df``."""
    keyed = [df.schema[k] for k in keys]
    typed = lambda columns: [f for f in StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in columns.items()))]
    states = StructType([StructField(k.name, k.dataType) for k in keyed] + typed(aggregate.state))
    results = StructType([StructField(k.name, k.dataType) for k in keyed] + typed(aggregate.result))
    states_schema, results_schema, names = to_arrow_schema(states), to_arrow_schema(results), list(aggregate.state)

    def merged(table: pa.Table) -> pa.Table:
        group, found = _group(table, keys)
        return _table(found, aggregate.merge(group, found.num_rows, {c: table[c].combine_chunks() for c in names}), states_schema)

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            group, found = _group(table, keys)
            held.append(_table(found, aggregate.update(group, found.num_rows, *(table[v].combine_chunks() for v in values)), states_schema))
            if sum(t.num_rows for t in held) >= HELD:
                held = [merged(pa.concat_tables(held))]
                if held[0].num_rows >= HELD // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from merged(pa.concat_tables(held)).combine_chunks().to_batches()

    def final(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """States come sorted by key; a key that goes on in the next batch waits for it."""
        held: pa.Table | None = None

        def finished(table: pa.Table) -> list[pa.RecordBatch]:
            return _table(table.select(list(keys)), aggregate.finish({c: table[c].combine_chunks() for c in names}), results_schema).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = merged(pa.concat_tables([held, table]) if held is not None else table)
            # the last row's key may go on; numbers of keys are not in the rows' order, so it is looked up
            same = np.ones(table.num_rows, bool)
            for k in keys:
                same &= _equal(table[k].combine_chunks(), batch.column(batch.schema.get_field_index(k))[batch.num_rows - 1])
            held = table.filter(pa.array(same))
            done = table.filter(pa.array(~same))
            if done.num_rows:
                yield from finished(done)
        if held is not None:
            yield from finished(held)

    sent = df.select(*keys, *[v for v in values if v not in keys]).mapInArrow(partial, states)
    return sent.repartition(*[F.col(f"`{k}`") for k in keys]).sortWithinPartitions(*[F.col(f"`{k}`") for k in keys]).mapInArrow(final, results)


class Welford(Aggregate):
    """Count, mean, population and sample deviation of a number, by merged moments; nulls are skipped."""

    state = {"n": "bigint", "mean": "double", "m2": "double"}
    result = {"n": "bigint", "mean": "double", "sd_pop": "double", "sd_samp": "double"}

    def update(self, group, n, x):
        on = pc.is_valid(x).to_numpy(zero_copy_only=False)
        g, v = group[on], x.cast(pa.float64()).drop_null().to_numpy()
        count = np.bincount(g, minlength=n)
        mean = np.bincount(g, v, n) / np.maximum(count, 1)
        return {"n": count, "mean": mean, "m2": np.bincount(g, (v - mean[g]) ** 2, n)}

    def merge(self, group, n, states):
        k, mean, m2 = (states[c].to_numpy(zero_copy_only=False) for c in ("n", "mean", "m2"))
        count = np.bincount(group, k, n)
        both = np.bincount(group, k * mean, n) / np.maximum(count, 1)
        return {"n": count.astype(np.int64), "mean": both, "m2": np.bincount(group, m2 + k * (mean - both[group]) ** 2, n)}

    def finish(self, states):
        n, mean, m2 = (states[c].to_numpy(zero_copy_only=False) for c in ("n", "mean", "m2"))
        none = n == 0
        return {"n": n, "mean": pa.array(mean, mask=none), "sd_pop": pa.array(np.sqrt(m2 / np.maximum(n, 1)), mask=none), "sd_samp": pa.array(np.sqrt(m2 / np.maximum(n - 1, 1)) * (n > 1), mask=none)}


class WeightedDecimals(Aggregate):
    """Exact sums of a decimal under whole weights, and from them mean and population variance to 28 digits; rows with a null are skipped.

    Sums are of up to 38 digits; one that is longer is an error.
    """

    state = {"w": "decimal(38,0)", "wx": "decimal(38,6)", "wxx": "decimal(38,12)"}
    result = {"weight": "decimal(38,0)", "total": "decimal(38,6)", "mean": "decimal(38,12)", "var_pop": "decimal(38,12)"}
    exact = Context(prec=38, traps=[Inexact])
    rounded = Context(prec=38, rounding=ROUND_HALF_EVEN)

    def _sums(self, group, n, *columns):
        out = [[Decimal(0)] * n for _ in columns]
        for total, column in zip(out, columns, strict=True):
            for g, v in zip(group.tolist(), column, strict=True):
                total[g] = self.exact.add(total[g], v)
        return {c: pa.array(v, pa.decimal128(38, s)) for (c, s), v in zip((("w", 0), ("wx", 6), ("wxx", 12)), out, strict=True)}

    def update(self, group, n, x, w):
        on = pc.and_(pc.is_valid(x), pc.is_valid(w)).to_numpy(zero_copy_only=False)
        xs, ws = (c.filter(pa.array(on)).to_pylist() for c in (x, w))
        ws = [Decimal(v) for v in ws]
        wx = [self.exact.multiply(a, b) for a, b in zip(ws, xs, strict=True)]
        return self._sums(group[on], n, ws, wx, [self.exact.multiply(a, b) for a, b in zip(wx, xs, strict=True)])

    def merge(self, group, n, states):
        return self._sums(group, n, *(states[c].to_pylist() for c in ("w", "wx", "wxx")))

    def finish(self, states):
        rows = list(zip(*(states[c].to_pylist() for c in ("w", "wx", "wxx")), strict=True))
        step, div = Decimal("1e-12"), self.rounded.divide
        mean = [div(b, a) if a else None for a, b, _ in rows]
        # (w * wxx - wx * wx) / w / w, whose numerator is exact in whole numbers
        whole = lambda a, b, c: int(a) * int(self.exact.scaleb(c, 12)) - int(self.exact.scaleb(b, 6)) ** 2
        var = [div(div(Decimal(whole(a, b, c)), Decimal(int(a) ** 2)), Decimal(10) ** 12) if a else None for a, b, c in rows]
        fixed = lambda vs: pa.array([None if v is None else v.quantize(step, context=self.rounded) for v in vs], pa.decimal128(38, 12))
        return {"weight": pa.array([a for a, _, _ in rows], pa.decimal128(38, 0)), "total": states["wx"], "mean": fixed(mean), "var_pop": fixed(var)}
