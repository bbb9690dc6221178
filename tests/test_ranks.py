"""Exact ranks over hot keys, ties, nulls and small groups, and no task with a key's whole values."""

import random
import statistics
from collections import Counter, defaultdict
from math import ceil

import pytest
from pyspark.sql import functions as F

from silt.operators import ranks


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = [("hot", float(rng.randrange(3000))) for _ in range(8000)] + [(f"k{i % 40}", rng.choice([1.0, 2.5, -3.0])) for i in range(300)]
    return out + [("one", 7.0), ("nulls", None), (None, 4.0), (None, 5.0), ("hot", None)]


def groups(rows):
    out = defaultdict(list)
    for k, x in rows:
        if x is not None:
            out[k].append(x)
    return {k: sorted(v) for k, v in out.items()}


def test_ranks(spark, rows):
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    want = groups(rows)
    got = ranks.ranked(df, ["k"], "x").collect()
    assert len(got) == sum(len(set(v)) for v in want.values())
    for r in got:
        v = want[r.k]
        assert (r.first_, r.last_, r.n_) == (v.index(r.x) + 1, v.index(r.x) + v.count(r.x), len(v))


def test_percentiles_and_medians(spark, rows):
    df = spark.createDataFrame(rows, "k string, x double")
    want = groups(rows)
    near = {(r.k, r.p): r.value for r in ranks.nearest_ranks(df, ["k"], "x", [1, 50, 95, 100]).collect()}
    assert near == {(k, p): v[max(1, ceil(len(v) * p / 100)) - 1] for k, v in want.items() for p in (1, 50, 95, 100)}
    inter = {(r.k, r.p): r.value for r in ranks.interpolated(df, ["k"], "x", [0.0, 0.3, 1.0]).collect()}
    for (k, p), value in inter.items():
        at = p * (len(want[k]) - 1)
        assert value == pytest.approx(want[k][int(at)] + (want[k][ceil(at)] - want[k][int(at)]) * (at - int(at)))
    assert {r.k: r["median"] for r in ranks.medians(df, ["k"], "x").collect()} == {k: statistics.median(v) for k, v in want.items()}


def test_outliers(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "k string, x double, med_k int")
    want = Counter()
    for k, v in groups(rows).items():
        med = statistics.median(v)
        mad = statistics.median(abs(x - med) for x in v)
        want.update((k, x) for x in v if (abs(x - med) > 0 if mad == 0 else 0.6745 * abs(x - med) / mad > 1.2))
    assert Counter((r.k, r.x) for r in ranks.mad_outliers(df, ["k"], "x", 1.2).collect()) == want


def test_a_hot_key_lies_in_many_tasks(spark):
    df = spark.range(40_000).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("x"))
    parts = []
    ranks.ranked(df, ["k"], "x", cut=lambda d: parts.append(d.cache()) or parts[-1])
    sizes = [r["count"] for r in parts[0].groupBy("part_").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 2 * 40_000 / len(sizes)
