"""Streams with event-time timers: unmatched openings are flushed, silent entities are given up, period baselines move on.

Rows may come in any order within the watermark's delay. They wait in state until the watermark has passed them and are
then taken in order of time (ties by ``what``), so results do not depend on how the stream was cut into batches. A call of
Python costs far more than a row, so keys share ``BUCKETS`` states by hash: a bucket reads and writes the rows and states of
its keys at once, and has one timer at the next moment at which something can happen to one of them: a waiting row becomes
final, or a deadline passes. State goes with the last deadline, so a key that has been silent for long enough costs nothing.
Rows later than the watermark are dropped by Spark. Rows without key or time are left out.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


#: Groups of keys that share a state, at most. A stream must always run with as many as it was begun with.
BUCKETS = 1024


class Ordered(StatefulProcessor):
    """Feeds each key's rows, in order of time, to ``take``; subclasses say what happens.

    ``state`` is any JSON value, None at first and when nothing is to be remembered. Times are microseconds.
    """

    def take(self, state, at: int, what: str | None, amount: float | None) -> tuple[object, list[tuple]]:
        """The state after a row, and rows of output."""
        raise NotImplementedError

    def deadline(self, state) -> int | None:
        """When ``expire`` is due if no row comes."""
        raise NotImplementedError

    def expire(self, state) -> tuple[object, list[tuple]]:
        raise NotImplementedError

    #: Output columns behind the key, with pandas types.
    columns: dict[str, str] = {}

    #: The key's type.
    key_type = "string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"key {self.key_type}, at long, what string, amount double")
        self.kept = handle.getListState("kept", f"key {self.key_type}, state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(k, int(a), None if pd.isna(w) else str(w), None if pd.isna(x) else float(x)) for part in rows for k, a, w, x in zip(*(part[c].tolist() for c in ("key", "at", "what", "amount")), strict=True)]
        yield from self._advance(new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance([], timerValues)

    def _advance(self, new: list[tuple], timer_values) -> Iterator[pd.DataFrame]:
        passed = timer_values.getCurrentWatermarkInMs() * 1000
        states = {k: json.loads(s) for k, s in self.kept.get()} if self.kept.exists() else {}
        held = self.waiting.exists()
        final: dict[object, list[tuple]] = {k: [] for k in states}
        left: list[tuple] = []
        for r in [*(self.waiting.get() if held else ()), *new]:
            if r[1] <= passed:
                final.setdefault(r[0], []).append(r)
            else:
                left.append(tuple(r))
        out: list[tuple] = []
        live: list[tuple] = []
        moments = [r[1] for r in left]
        for key, rows in final.items():
            state, found = self._taken(states.get(key), sorted(rows, key=lambda r: (r[1], r[2] or "")), passed)
            out += [(key, *o) for o in found]
            if state is not None:
                live.append((key, json.dumps(state)))
                due = self.deadline(state)
                moments += [] if due is None else [due]
        if live:
            self.kept.put(live)
        elif states:
            self.kept.clear()
        if left:
            self.waiting.put(left)
        elif held:
            self.waiting.clear()
        at = [max(min(moments), passed) // 1000 + 1] if moments else []
        timers = list(self.handle.listTimers())
        if timers != at:
            for old in timers:
                self.handle.deleteTimer(old)
            for t in at:
                self.handle.registerTimer(t)
        if out:
            yield pd.DataFrame({"key": pd.Series([o[0] for o in out], dtype=object)} | {c: pd.array([o[i] for o in out], t) for i, (c, t) in enumerate(self.columns.items(), 1)})

    def _taken(self, state, rows: list[tuple], passed: int) -> tuple[object, list[tuple]]:
        """A key's state and output once time has passed its rows, which are in order."""
        out: list[tuple] = []
        for _, at, what, amount in rows:
            while (due := self.deadline(state)) is not None and due < at:
                state, more = self.expire(state)
                out += more
            state, more = self.take(state, at, what, amount)
            out += more
        while (due := self.deadline(state)) is not None and due <= passed:
            state, more = self.expire(state)
            out += more
        return state, out

    def close(self) -> None:
        pass


class Calls(Ordered):
    """An opening waits for its closing for at most ``wait``; another opening, or time, flushes it. A closing without an opening passes through."""

    columns = {"opened": "Int64", "closed": "Int64"}

    def __init__(self, opens: str, closes: str, wait: int):
        self.opens, self.closes, self.wait = opens, closes, wait

    def take(self, state, at, what, amount):
        if what == self.opens:
            return at, [(state, None)] if state is not None else []
        return None, [(state, at)]

    def deadline(self, state):
        return None if state is None else state + self.wait

    def expire(self, state):
        return None, [(state, None)]


class Watch(Ordered):
    """Gives a key up when its value has not changed for ``quiet``; a later row starts a new watch."""

    columns = {"since": "Int64", "changes": "Int64"}

    def __init__(self, quiet: int):
        self.quiet = quiet

    def take(self, state, at, what, amount):
        if state is None:
            return [at, what, 0], []
        last, value, changes = state
        return ([last, value, changes] if what == value else [at, what, changes + 1]), []

    def deadline(self, state):
        return None if state is None else state[0] + self.quiet

    def expire(self, state):
        return None, [(state[0], state[2])]


class Baselines(Ordered):
    """The rate of each row against the last row of the period before; the baseline moves when a row of a new period closes the old one. A key is forgotten ``idle`` after its last row."""

    columns = {"at": "Int64", "rate": "Float64"}

    def __init__(self, period: int, idle: int):
        self.period, self.idle = period, idle

    def take(self, state, at, what, amount):
        base, last = state or (None, None)
        if last is not None and last[0] // self.period < at // self.period:
            base = last
        rate = (amount - base[1]) * 1e6 / (at - base[0]) if base is not None and amount is not None and at > base[0] else None
        return [base, last if amount is None else [at, amount]], [(at, rate)]

    def deadline(self, state):
        return None if state is None or state[1] is None else state[1][0] + self.idle

    def expire(self, state):
        return None, []


def _timed(stream: DataFrame, key: str, at: str, what, amount, late: str, processor: Ordered, schema: str, keep=None) -> DataFrame:
    """``keep`` leaves rows out behind the watermark: these move time on and touch no state."""
    timed = stream.withColumn("time_", F.col(at).cast("timestamp")).withWatermark("time_", late)
    held = F.col(key).isNotNull() & (F.lit(True) if keep is None else F.coalesce(keep, F.lit(False)))
    # a condition on the time is not pushed below the watermark, so rows that are left out move it on
    rows = timed.filter(F.when(F.col("time_").isNotNull(), held).otherwise(False)).select(F.col(key).alias("key"), "time_", F.unix_micros("time_").alias("at"), what.cast("string").alias("what"), amount.cast("double").alias("amount"))
    processor.key_type = rows.schema["key"].dataType.simpleString()
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
    return dealt.groupBy("bucket").transformWithStateInPandas(processor, f"key {processor.key_type}, {schema}", "Append", "EventTime")


def calls(stream: DataFrame, key: str, kind: str, at: str, opens: str, closes: str, wait_s: int, late: str) -> DataFrame:
    """(key, opened, closed), in microseconds: matched calls, closings without an opening, openings that found no closing within ``wait_s``."""
    none = F.lit(None)
    return _timed(stream, key, at, F.col(kind), none, late, Calls(opens, closes, wait_s * 1_000_000), "opened long, closed long", F.col(kind).isin(opens, closes))


def given_up(stream: DataFrame, key: str, at: str, value: str, quiet_s: int, late: str, keep=None) -> DataFrame:
    """(key, since, changes): a key whose value did not change for ``quiet_s`` from ``since`` on, and how often it had changed before."""
    return _timed(stream, key, at, F.col(value), F.lit(None), late, Watch(quiet_s * 1_000_000), "since long, changes long", keep)


def period_rates(stream: DataFrame, key: str, at: str, counter: str, period_s: int, idle_s: int, late: str, tie: str, keep=None) -> DataFrame:
    """(key, at, rate): each row's growth a second since the last row of an earlier period; null where there is none.

    Of rows of one time the one with the greatest ``tie`` comes last.
    """
    return _timed(stream, key, at, F.lpad(F.col(tie).cast("string"), 20, "0"), F.col(counter), late, Baselines(period_s * 1_000_000, idle_s * 1_000_000), "at long, rate double", keep)


def in_slices(slices: list[Callable[[], None]], run: Callable[[], DataFrame]) -> DataFrame:
    """Let each slice of rows arrive, then run the stream over what is new; what the last run has in its sink is all output."""
    out = None
    for arrive in slices:
        arrive()
        out = run()
    return out
