"""Pivot index, incremental components, JSON leaves and generators against brute force and odd values."""

import json
import random

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from silt.functions import generators
from silt.operators import graph, leaves, metric


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("radius,pivots", [(0, 1), (1, 3), (3, 5)])
def test_edit_distance_lookup_equals_brute_force(spark, tmp_path, radius, pivots):
    rng = random.Random(radius)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(300)] + ["", "ünï", "a" * 40]
    df = spark.createDataFrame([(w,) for w in [*words, *words[:50]]] + [(None,)], "w string")
    index = metric.PivotIndex.of(df, "w", metric.edits, pivots)
    index.save(str(tmp_path / "i"))
    index = metric.PivotIndex.load(spark, str(tmp_path / "i"), metric.edits)
    asked = words[::7] + ["zzzz", None]
    got = index.within(spark.createDataFrame([(w,) for w in asked], "q string"), "q", radius)
    want = sorted({(q, w, lev(q, w)) for q in asked if q is not None for w in words if lev(q, w) <= radius})
    assert sorted(map(tuple, got.collect())) == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_hamming_lookup_prunes(spark):
    rng = random.Random(5)
    hashes = [rng.getrandbits(64) - 2**63 for _ in range(300)]
    hashes += [h ^ (1 << rng.randrange(63)) for h in hashes[:100]]
    df = spark.createDataFrame([(h,) for h in hashes], "h long")
    index = metric.PivotIndex.of(df, "h", metric.hamming, 8)
    asked = df.limit(40)
    ids = [r.h for r in asked.collect()]
    got = {tuple(r) for r in index.within(asked, "h", 3).collect()}
    assert got == {(a, b, bin((a ^ b) & (2**64 - 1)).count("1")) for a in ids for b in hashes if bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    assert index.kept_share(asked, "h", 3) < 0.25


def test_a_callers_own_distance_and_new_values(spark):
    def taxicab(a, b):
        return F.abs(a["x"] - b["x"]) + F.abs(a["y"] - b["y"])

    rng = random.Random(6)
    points = [(rng.randrange(100), rng.randrange(100)) for _ in range(200)]
    frame = lambda ps: spark.createDataFrame([((x, y),) for x, y in ps], "p struct<x:int,y:int>")
    distance = lambda a, b: taxicab(a, b)
    pivots = [(0, 0), (99, 0)]
    lit = lambda p: F.struct(F.lit(p[0]).alias("x"), F.lit(p[1]).alias("y"))
    over = lambda a, b: distance(a, b if not isinstance(b, tuple) else lit(b))
    entries = frame(points[:120]).distinct().select(F.col("p").alias("value"), F.array(*[taxicab(F.col("p"), lit(p)).cast("double") for p in pivots]).alias("d"))
    index = metric.PivotIndex(entries, pivots, over)
    assert index.entries.count() == len(set(points[:120]))
    near = metric.PivotIndex.of(spark.createDataFrame([(x,) for x, _ in points[:100]], "v int"), "v", lambda a, b: F.abs(a - b), 2).with_new(spark.createDataFrame([(x,) for x, _ in points], "v int"), "v")
    got = {tuple(r)[:2] for r in near.within(spark.createDataFrame([(50,)], "q int"), "q", 5).collect()}
    assert got == {(50, x) for x in {x for x, _ in points} if abs(x - 50) <= 5}


def test_an_empty_index(spark):
    none = spark.createDataFrame([], "w string")
    assert metric.PivotIndex.of(none, "w", metric.edits).within(spark.createDataFrame([("a",)], "q string"), "q", 2).collect() == []


def parts_of(edges):
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in root}


def test_components_follow_random_changes(spark):
    rng = random.Random(7)
    edges = {tuple(sorted(rng.sample(range(120), 2))) for _ in range(70)}
    frame = lambda e: spark.createDataFrame(sorted(e), "a long, b long")
    labels = graph.components(frame(edges))
    for _ in range(3):
        removed = set(rng.sample(sorted(edges), 8))
        added = {tuple(sorted(rng.sample(range(140), 2))) for _ in range(8)} - edges
        before = parts_of(edges)
        labels, touched = graph.updated_components(labels, frame(edges - removed), frame(removed), frame(added))
        edges = (edges - removed) | added
        assert {r.node: r.component for r in labels.collect()} == parts_of(edges)
        hurt = {before[a] for a, _ in removed}
        assert {r.node for r in touched.collect()} == {n for n, c in before.items() if c in hurt}


def test_one_edge_touches_one_component(spark):
    chain = [(i, i + 1) for i in range(100)] + [(1000 + 2 * i, 1001 + 2 * i) for i in range(500)]
    frame = lambda e: spark.createDataFrame(e, "a long, b long")
    gone = [(1000, 1001)]
    labels, touched = graph.updated_components(graph.components(frame(chain)), frame([e for e in chain if e not in gone]), frame(gone), frame(chain[:0] or [(5, 1002)]))
    assert touched.count() == 2
    got = {r.node: r.component for r in labels.collect()}
    assert 1000 not in got and got[1002] == got[1003] == 0 and got[1004] == 1004 and len(got) == 101 + 998


DOCS = ['{"a":1,"b":[1,{"c":"x"},null,1.50,true,false],"e":{},"f":[]}', "[5]", "7", '"text"', "true", "false", "null", "bad", "", None, '{"a":{"a":{"a":{"a":{"a":[[["deep"]]]}}}}}', '{"x y":{"":1}}', '{"n":-3,"big":12345678901234567890}']


def flat(path, v):
    join = f"{path}." if path else ""
    if isinstance(v, dict):
        return [x for k, y in v.items() for x in flat(f"{join}{k}", y)]
    if isinstance(v, list):
        return [x for i, y in enumerate(v) for x in flat(f"{join}[{i}]", y)]
    return [] if v is None or v is False else [(path, "true" if v is True else str(v))]


def test_leaves_of_odd_documents(spark):
    df = spark.createDataFrame([(i, d, "x") for i, d in enumerate(DOCS)], "id int, doc string, path string")
    got = sorted(map(tuple, leaves.json_leaves(df, ["id"], "doc").collect()))
    want = []
    for i, d in enumerate(DOCS):
        try:
            want += [(i, p, v) for p, v in flat("", json.loads(d))]
        except (TypeError, ValueError):
            pass
    assert got == sorted(want)


def test_selected_leaves_nulls_out(spark):
    df = spark.createDataFrame([('{"a":{"b":1},"c":null,"d":[1,2]}',), ("bad",), (None,), ("{}",)], "doc string")
    got = [r.s for r in df.select(leaves.selected(F.col("doc"), {"x": "$.a.b", "y": "$.c", "z": "$.d[1]", "w": "$.none"}).alias("s")).collect()]
    assert got == ['{"x":1,"z":2}', None, None, "{}"]


def test_generators_in_sql(spark):
    generators.register(spark)
    spark.createDataFrame([(1, "1\nx\n 2.5 \n"), (2, None), (3, "x\n4"), (4, "")], "id int, t string").createOrReplaceTempView("texts_")
    ask = lambda policy: sorted(map(tuple, spark.sql(f"SELECT id, pos, value FROM texts_, LATERAL numbers_of(t, '{policy}')").collect()))
    assert ask("skip") == [(1, 0, 1.0), (1, 2, 2.5), (3, 1, 4.0)]
    assert ask("stop") == [(1, 0, 1.0)]
    assert ask("zero") == [(1, 0, 1.0), (1, 1, 0.0), (1, 2, 2.5), (1, 3, 0.0), (3, 0, 0.0), (3, 1, 4.0), (4, 0, 0.0)]
    with pytest.raises(PythonException):
        ask("raise")
    assert spark.sql("SELECT * FROM bins_of(0, 1, 2)").collect() == [(0, 0.0, 0.5), (1, 0.5, 1.0)] and spark.sql("SELECT * FROM bins_of(1, 1, 2)").collect() == []
