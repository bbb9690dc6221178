"""Walks of a key's rows in order, where what comes next depends on what was decided before.

Rows are brought together by key and sorted by Spark, which spills where it must, and stream through the task: it holds what
the walk remembers, never a key's rows. A key is one task's, as its rows depend on one another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: (what is remembered, a row's values) -> (what is remembered, rows of output)
Step = Callable[[object, tuple], tuple[object, list[tuple]]]
ROWS = 4096


def folded(df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: Sequence[str], step: Step, schema: str, finish: Callable[[object], list[tuple]] = lambda state: []) -> DataFrame:
    """``keys`` with the columns of ``schema``: what ``step`` gives for each row in order, from None on, and ``finish`` at a key's end."""
    key = [StructField(k, df.schema[k].dataType) for k in keys]
    kind = StructType([*key, *StructType.fromDDL(schema)])
    arrow, width = to_arrow_schema(kind), len(keys)
    names = [f"k{i}_" for i in range(width)] + [f"v{i}_" for i in range(len(values))]
    sort = [F.struct(*order).alias("o_")] if order else []
    rows = df.select(*[F.col(k).alias(n) for k, n in zip([*keys, *values], names, strict=True)], *sort)
    walked = rows.repartition(*names[:width]).sortWithinPartitions(*names[:width], *[c for c in ("o_",) if order]).select(*names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, out = None, None, []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

        for whole in batches:
            for part in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if row[:width] != at:
                        if at is not None:
                            out += [(*at, *r) for r in finish(state)]
                        at, state = row[:width], None
                    state, more = step(state, row[width:])
                    out += [(*at, *r) for r in more]
                if len(out) >= ROWS:
                    yield batch()
                    out = []
        if at is not None:
            out += [(*at, *r) for r in finish(state)]
        if out:
            yield batch()

    return walked.mapInArrow(run, kind)
