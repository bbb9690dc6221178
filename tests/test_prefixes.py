"""Joins with tables of folders and of patterns: brute force, odd values, size, and plans without nested loops."""

import fnmatch

import numpy as np
import pytest
from pyspark.sql import functions as F

from silt.operators import catalog, prefixes


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def no_loop(df):
    text = plan(df)
    return "NestedLoop" not in text and "Cartesian" not in text


def under(path, folder):
    folder = folder.rstrip("/")
    return folder in ("", ".") or path.rstrip("/") == folder or path.startswith(folder + "/")


FOLDERS = ["a", "b/c/", "/abs", "b/cc", "deep/er/est", "a", None, "x/y.z"]
PATHS = ["a", "a/", "a/b", "ab", "b", "b/c", "b/c/d/e", "b/cd", "b/cc/f", "/abs/x", "abs/x", "deep/er", "deep/er/est/f", "x/y.z", "x/yyz/f", "", "ünï/cøde"]


def test_below_equals_brute_force(spark):
    rows = spark.createDataFrame([(i, p, 1, "z") for i, p in enumerate([*PATHS, None, "a/b"])], "id int, path string, folder_ int, dir_ string")
    folders = spark.createDataFrame([(f,) for f in FOLDERS], "folder string")
    got = prefixes.marked_below(rows, "path", folders)
    assert got.columns == [*rows.columns, "below"] and all((r.folder_, r.dir_) == (1, "z") for r in got.collect())
    have = {r.id: r.below for r in got.collect()}
    want = {i: p is not None and any(under(p, f) for f in FOLDERS if f is not None) for i, p in enumerate([*PATHS, None, "a/b"])}
    assert have == want and no_loop(got)
    assert prefixes.below(rows.select("id", "path"), "path", [""]).count() == len(PATHS) + 1
    assert prefixes.not_below(rows.select("id", "path"), "path", []).count() == len(PATHS) + 2


def test_a_hundred_thousand_folders(spark):
    """Of 300,000 paths below 1000 directories; a third lie below one folder."""
    paths = spark.range(300_000).select(F.expr("CASE WHEN id % 3 = 0 THEN concat('hot/', id % 1000, '/f', id) ELSE concat('t', id % 50, '/', id % 1000, '/f', id) END").alias("path"))
    folders = spark.range(100_000).select(F.expr("CASE WHEN id = 0 THEN 'hot' ELSE concat('t', id % 50, '/', id) END").alias("folder"))
    gone = catalog.protected_deletes(paths, paths.limit(0), "path", folders)
    assert no_loop(gone)
    # t{i % 50}/{i % 1000} is a folder of the table unless i % 1000 is 0
    assert gone.count() == sum(1 for i in range(0, 300_000, 1000) if i % 3)


def test_pruned_takes_a_table_of_roots(spark):
    base = spark.createDataFrame([(p,) for p in ("r/a", "r/b", "rx/a", "s/a", "s/b/c", "t")], "path string")
    seen = spark.createDataFrame([("r/a",), ("t",)], "path string")
    roots = spark.createDataFrame([("r",), ("s/b",)], "folder string")
    assert sorted(r.path for r in catalog.pruned(base, seen, "path", roots).collect()) == ["r/a", "rx/a", "s/a", "t"]


PATTERNS = ["abc*", "*xyz", "*mid*", "a*z", "whole", "?bc", "*", "??", "???*", "", "a.c*", "a+(b)*", "*[1]*", "longliteralbeginningofmorethanthirtytwocharacters*", "*é?", "a\nb*", "*a*b*c*", None]
NAMES = ["abc", "abcxyz", "xyz", "a mid z", "amidz", "whole", "wholes", "xbc", "", "ab", "abd", "a.cd", "axcd", "a+(b)!", "x[1]y", "x1y", "longliteralbeginningofmorethanthirtytwocharacters!", "caféx", "a\nbc", "a1b2c3", "cba", None]


def fits(name, pattern):
    return fnmatch.fnmatchcase(name, pattern.replace("[", "[[]"))


def test_patterns_equal_brute_force(spark):
    names = spark.createDataFrame([(n,) for n in [*NAMES, "abc"]], "n string")
    patterns = spark.createDataFrame([(p,) for p in [*PATTERNS, "abc*"]], "p string")
    got = prefixes.pattern_matches(names, "n", patterns, "p")
    assert sorted(map(tuple, got.collect())) == sorted((n, p) for n in NAMES for p in PATTERNS if None not in (n, p) and fits(n, p)) and no_loop(got)
    how = {r.pattern: (r.how, r.key) for r in prefixes.pattern_keys(patterns, "p").collect()}
    assert how["abc*"] == ("begin", "ab") and how["*xyz"] == ("end", "yz") and how["*mid*"] == ("inside", "mid") and how["whole"][0] == "whole" and how["???*"] == ("bare", None)
    with pytest.raises(ValueError):
        prefixes.pattern_matches(names, "n", spark.createDataFrame([("?" * k,) for k in range(1, 80)], "p string"), "p")


def test_ten_thousand_patterns(spark):
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnop"), n))
    stems = [word(6) for _ in range(5000)]
    names = spark.createDataFrame([(f"{s}.{k}", 1) for s in stems for k in range(20)], "name string, v int")
    patterns = spark.createDataFrame([(f"{s}*" if i % 2 else f"{s[:5]}?.1*",) for i, s in enumerate(stems)] + [(f"*{s[2:]}.7",) for s in stems], "pattern string")
    got = prefixes.pattern_sums(names, "name", "v", patterns, "pattern")
    assert no_loop(got)
    have = {r.pattern: r.n for r in got.collect()}
    assert len(have) > 9000
    for p in list(have)[:: len(have) // 25]:
        assert have[p] == sum(fits(f"{s}.{k}", p) for s in stems for k in range(20)), p
