"""Timed streams: late rows, any cut into batches, deadlines, and state that is empty at the end."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from silt.streaming import stateful, timed

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "k string, kind string, n long, ts timestamp"


def us(seconds):
    return int((START + timedelta(seconds=seconds)).timestamp() * 1e6)


def run(spark, tmp_path, batches, stream):
    """Rows out of (key, kind, number, second) batches; the last run's output, and how many rows its state holds."""
    at = str(tmp_path)
    put = lambda rows: lambda: spark.createDataFrame([(k, kind, n, START + timedelta(seconds=s)) for k, kind, n, s in rows], SCHEMA).write.mode("append").parquet(f"{at}/rows")
    end = [(None, None, None, 10**7)]  # moves time on
    rows = timed.in_slices([put(b) for b in [*batches, end]], lambda: stateful.run_once(stream(stateful.file_stream(spark, f"{at}/rows")), "append", f"{at}/state", f"{at}/out"))
    return sorted((tuple(r)[:-1] for r in rows.collect()), key=str)


def cut(rows, n, seed, late):
    """Rows in n batches, each row at most ``late`` seconds after its time."""
    rng = random.Random(seed)
    arrival = sorted((r[3] + rng.uniform(0, late), r) for r in rows)
    return [[r for _, r in arrival[len(rows) * i // n : len(rows) * (i + 1) // n]] for i in range(n)]


def test_calls_in_any_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice(["open", "close", "other"]), None, t * 10) for t in range(60)]
    want = []
    for key in "ab":
        waiting = None
        for _, kind, _, s in sorted((r for r in rows if r[0] == key and r[1] != "other"), key=lambda r: r[3]):
            if waiting is not None and (kind == "open" or s - waiting > 25):
                want.append((key, us(waiting), None))
                waiting = None
            if kind == "open":
                waiting = s
            else:
                want.append((key, None if waiting is None else us(waiting), us(s)))
                waiting = None
        if waiting is not None:
            want.append((key, us(waiting), None))
    for n in (1, 4):
        got = run(spark, tmp_path / str(n), cut(rows, n, n, 40), lambda s: timed.calls(s, "k", "kind", "ts", "open", "close", 25, "60 seconds"))
        assert got == sorted(want, key=str)


def test_rows_that_are_too_late_are_dropped_and_silence_ends_a_watch(spark, tmp_path):
    batches = [[("a", "x", None, 0), ("a", "x", None, 50)], [("a", "y", None, 60), ("b", "z", None, 500)], [("a", "late", None, 70), ("b", "z", None, 520)]]
    got = run(spark, tmp_path, batches, lambda s: timed.given_up(s, "k", "ts", "kind", 100, "30 seconds"))
    assert got == [("a", us(60), 1), ("b", us(500), 0)]  # the third row of a came 430 s after its time


def test_a_watch_begins_again_after_giving_up(spark, tmp_path):
    rows = [[("a", "x", None, 0), ("a", "x", None, 90), ("a", "x", None, 150), ("a", "y", None, 260)]]
    got = run(spark, tmp_path, rows, lambda s: timed.given_up(s, "k", "ts", "kind", 100, "0 seconds"))
    assert got == [("a", us(0), 0), ("a", us(150), 0), ("a", us(260), 0)]


def test_baselines_move_when_a_period_closes(spark, tmp_path):
    rows = [("a", "", n, s) for n, s in ((0, 1), (10, 6), (30, 12), (50, 18), (90, 25), (95, 500))]
    got = {r[1]: r[2] for r in run(spark, tmp_path, cut(rows, 2, 1, 3), lambda s: timed.period_rates(s, "k", "ts", "n", 10, 100, "5 seconds", "n"))}
    # periods of 10 s from the epoch: 1, 6 | 12, 18 | 25 | 500, which comes after the key was forgotten
    assert got == {us(1): None, us(6): None, us(12): pytest.approx(20 / 6), us(18): pytest.approx(40 / 12), us(25): pytest.approx(40 / 7), us(500): None}


def test_state_is_empty_at_the_end(spark, tmp_path):
    rows = [(f"k{i}", "open", i, i) for i in range(200)]
    run(spark, tmp_path, [rows], lambda s: timed.calls(s, "k", "kind", "ts", "open", "close", 50, "10 seconds"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKS)
    try:
        at = lambda name: spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", name)
        assert at("kept").load().count() == 0
        assert at("waiting").option("flattenCollectionTypes", True).load().count() == 0
        earlier = at("kept").option("batchId", 1).load()
        assert earlier.count() == 49  # openings from 140 s to 188 s: time had come to 189 s
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert spark.read.parquet(f"{tmp_path}/out").filter(F.col("closed").isNull()).count() == 200
