"""Aggregates of a caller's own: against plain sums, over hot and odd keys, and with a partial step in the plan."""

from collections import defaultdict
from decimal import Decimal
from fractions import Fraction
from statistics import fmean, pstdev, stdev

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from silt.operators import aggregates as ag


def test_welford_over_hot_and_odd_keys(spark, monkeypatch):
    monkeypatch.setattr(ag, "HELD", 50)
    rng = np.random.default_rng(1)
    rows = [("hot" if i % 3 else None if i % 2 else f"k{i % 400}", float("nan") if i % 50 == 0 else float(i % 2), None if i % 11 == 0 else float(rng.normal(5, 2))) for i in range(6000)] + [("only null", 1.0, None)]
    want = defaultdict(list)
    for a, b, x in rows:
        want[a, str(b)] += [] if x is None else [x]
    df = spark.createDataFrame(rows, "a string, b double, x double").repartition(7)
    got = ag.aggregated(df, ["a", "b"], ["x"], ag.Welford()).collect()
    assert len(got) == len(want)
    for r in got:
        xs = want[r.a, str(r.b)]
        assert r.n == len(xs)
        if xs:
            assert r["mean"] == pytest.approx(fmean(xs)) and r.sd_pop == pytest.approx(pstdev(xs)) and r.sd_samp == pytest.approx(stdev(xs) if len(xs) > 1 else 0)
        else:
            assert r["mean"] is None and r.sd_pop is None


def test_only_states_are_shuffled(spark):
    df = spark.range(0, 100_000, 1, 4).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("x"))
    got = ag.aggregated(df, ["k"], ["x"], ag.Welford())
    lines = [x.strip() for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    steps = [next(i for i, x in enumerate(lines) if w in x) for w in ("MapInArrow final", "Sort", "Repartition", "MapInArrow partial")]
    assert steps == sorted(steps)
    got.collect()
    sent = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in sent
    # three keys of four tasks
    assert df.select("k", "x").mapInArrow(lambda b: b, "k long, x double").count() == 100_000
    assert sorted((r.k, r.n) for r in got.collect()) == [(0, 33334), (1, 33333), (2, 33333)]


def test_weighted_decimals_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), Decimal(int(x)).scaleb(-6), int(w)) for k, x, w in zip(rng.integers(0, 5, 2000), rng.integers(-(10**12), 10**12, 2000), rng.integers(0, 1000, 2000))]
    rows += [(1, None, 3), (2, Decimal(1), None), (9, None, None), (8, Decimal(5), 0)]
    got = {r.k: r for r in ag.aggregated(spark.createDataFrame(rows, "k int, x decimal(18,6), w long"), ["k"], ["x", "w"], ag.WeightedDecimals()).collect()}
    for k in range(5):
        mine = [(Fraction(x), w) for g, x, w in rows if g == k and x is not None and w is not None]
        w = sum(w for _, w in mine)
        mean = sum(x * w for x, w in mine) / w
        var = sum(w * (x - mean) ** 2 for x, w in mine) / w
        assert got[k].weight == w and Fraction(got[k].total) == sum(x * w for x, w in mine)
        assert abs(Fraction(got[k]["mean"]) - mean) <= Fraction(1, 10**12) and abs(Fraction(got[k].var_pop) - var) <= Fraction(1, 10**12)
    assert got[9].weight == 0 and got[9]["mean"] is None and got[8]["mean"] is None


class Longest(ag.Aggregate):
    """A caller's aggregate over texts."""

    state = {"best": "string"}
    result = {"best": "string", "length": "bigint"}

    def _best(self, group, n, texts):
        out = [None] * n
        for g, t in zip(group.tolist(), texts.to_pylist()):
            if t is not None and (out[g] is None or (-len(t), t) < (-len(out[g]), out[g])):
                out[g] = t
        return {"best": pa.array(out, pa.string())}

    def update(self, group, n, texts):
        return self._best(group, n, texts)

    def merge(self, group, n, states):
        return self._best(group, n, states["best"])

    def finish(self, states):
        return states | {"length": pa.array([None if t is None else len(t) for t in states["best"].to_pylist()], pa.int64())}


def test_a_callers_own_triple(spark):
    df = spark.createDataFrame([(1, "a"), (1, "bbb"), (1, "aaa"), (2, None)], "k int, t string").repartition(3)
    assert sorted(map(tuple, ag.aggregated(df, ["k"], ["t"], Longest()).collect())) == [(1, "aaa", 3), (2, None, None)]
    assert ag.aggregated(df.limit(0), ["k"], ["t"], Longest()).collect() == []
