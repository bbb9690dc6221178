"""Versioned catalogues: brute force over random changes, crashes, conflicts, and what an update rewrites."""

import os
import random
import signal
import subprocess
import sys
from pathlib import Path

import pytest

from silt.sources.versions import Catalogue, Conflict

SCHEMA = "k string, g int, v string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_random_changes_equal_a_dict(spark, tmp_path):
    rng = random.Random(1)
    cat = Catalogue(spark, str(tmp_path / "c"), ["k", "g"], 4)
    held = {}
    for step in range(6):
        new = {(f"k{rng.randrange(40)}" if rng.random() < 0.95 else None, rng.randrange(3)): f"v{step}" for _ in range(25)}
        held |= new
        cat.upsert(spark.createDataFrame([(*k, v) for k, v in new.items()], SCHEMA))
        gone = rng.sample(sorted(held, key=str), 5)
        held = {k: v for k, v in held.items() if k not in gone}
        assert cat.delete(spark.createDataFrame(gone, "k string, g int")) == 2 * step + 2
        assert rows(cat.read()) == sorted(((*k, v) for k, v in held.items()), key=str)
    assert cat.history().filter("operation = 'upsert'").count() == 6
    cat.vacuum(keep=2)
    assert cat.versions() == [11, 12] and rows(cat.read()) == sorted(((*k, v) for k, v in held.items()), key=str)


def test_an_update_rewrites_only_its_buckets(spark, tmp_path):
    cat = Catalogue(spark, str(tmp_path / "c"), ["k"], 32)
    cat.replace(spark.createDataFrame([(f"k{i}", i, "a") for i in range(500)], SCHEMA))
    before = cat._manifest()["buckets"]
    cat.upsert(spark.createDataFrame([("k7", 0, "b")], SCHEMA))
    after = cat._manifest()["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1 and cat.history().collect()[-1].buckets == 1
    assert cat.read(1).filter("v = 'b'").count() == 0 and cat.read().filter("v = 'b'").count() == 1


def test_the_last_of_repeated_updates(spark, tmp_path):
    cat = Catalogue(spark, str(tmp_path / "c"), ["k"], 2)
    cat.upsert(spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y")], SCHEMA), order="g")
    assert rows(cat.read()) == [("a", 3, "z")]
    cat.delete(spark.createDataFrame([("a",)], "k string"))
    assert rows(cat.read()) == []


def test_of_two_writers_one_gets_a_conflict(spark, tmp_path):
    at = str(tmp_path / "c")
    a = Catalogue(spark, at, ["k"], 2)
    a.replace(spark.createDataFrame([("a", 1, "x")], SCHEMA))
    other = Catalogue(spark, at, ["k"], 2)
    once = []

    def meanwhile():
        if not once:
            once.append(1)
            other.upsert(spark.createDataFrame([("b", 2, "y")], SCHEMA))

    a.before_publishing = meanwhile
    with pytest.raises(Conflict):
        a.upsert(spark.createDataFrame([("c", 3, "z")], SCHEMA))
    assert rows(a.read()) == [("a", 1, "x"), ("b", 2, "y")]
    once.clear()
    assert a.retried(lambda c: c.upsert(spark.createDataFrame([("c", 3, "z")], SCHEMA))) == 4  # the other one put b in again
    assert rows(a.read()) == [("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z")]


KILLED = """
import os, signal, sys
from pyspark.sql import SparkSession
from silt.sources.versions import Catalogue
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
cat = Catalogue(spark, sys.argv[1], ["k"], 4, before_publishing=lambda: os.kill(os.getpid(), signal.SIGKILL))
cat.upsert(spark.createDataFrame([("a", 9, "new"), ("b", 9, "new")], "k string, g int, v string"))
"""


def test_a_killed_writer_leaves_the_old_version(spark, tmp_path):
    at = str(tmp_path / "c")
    cat = Catalogue(spark, at, ["k"], 4)
    cat.replace(spark.createDataFrame([("a", 1, "old"), ("c", 1, "old")], SCHEMA))
    written = set(os.listdir(f"{at}/data"))
    root = Path(__file__).resolve().parents[1]
    env = os.environ | {"PYTHONPATH": f"{root}:{os.environ.get('PYTHONPATH', '')}"}
    done = subprocess.run([sys.executable, "-c", KILLED, at], env=env, capture_output=True, timeout=300)
    assert done.returncode == -signal.SIGKILL
    left = set(os.listdir(f"{at}/data")) - written
    assert len(left) == 1  # it had written all
    assert rows(cat.read()) == [("a", 1, "old"), ("c", 1, "old")] and cat.versions() == [1]
    assert set(cat.vacuum(keep=1)) == left
    assert cat.upsert(spark.createDataFrame([("a", 9, "new")], SCHEMA)) == 2 and rows(cat.read()) == [("a", 9, "new"), ("c", 1, "old")]
