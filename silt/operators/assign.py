"""Sequential decisions: greedy one-to-one matching, subset sums, folds of captions. Rows stream; a task holds what a group has taken, or said, so far."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from silt.operators import fold


def scored(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_tokens: Column, right_tokens: Column, score, floor: float, within: Sequence[str] = ()) -> DataFrame:
    """(l, r, score) of pairs that share a token, and the columns ``within`` which come first, and reach the floor. A pair without one scores 0, so none is lost."""
    a = left.select(*within, F.col(left_id).alias("l"), left_tokens.alias("lt")).withColumn("token", F.explode(F.array_distinct("lt")))
    b = right.select(*within, F.col(right_id).alias("r"), right_tokens.alias("rt")).withColumn("token", F.explode(F.array_distinct("rt")))
    first = F.element_at(F.array_sort(F.array_intersect("lt", "rt")), 1)
    pairs = a.join(b, [*within, "token"]).filter(F.col("token") == first)  # each pair once, at its first shared token
    return pairs.select(*within, "l", "r", score(F.col("lt"), F.col("rt")).alias("score")).filter(F.col("score") >= floor)


def best_match(pairs: DataFrame) -> DataFrame:
    """The best right row of each left row; ties keep the least."""
    w = Window.partitionBy("l").orderBy(F.desc("score"), "r")
    return pairs.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def greedy_assignment(pairs: DataFrame, group: str) -> DataFrame:
    """One-to-one matches: left rows in order take their best right row that is left, ties the least; within each group."""

    def step(state, row):
        taken, done = state or (set(), None)
        left, right, score = row
        if (left,) == done or right in taken:
            return (taken, done), []
        taken.add(right)
        return (taken, (left,)), [(left, right, score)]

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    order = [F.col("l"), -F.col("score"), F.col("r")]
    return fold.folded(pairs, [group], order, ["l", "r", "score"], step, f"l {kinds['l']}, r {kinds['r']}, score double")


def subset_sum(items: DataFrame, keys: Sequence[str], size: str, capacity: int, item: str | None = None) -> DataFrame:
    """``filled``, the largest sum of sizes, each used once, that fits the capacity, and ``chosen``, the items that make it.

    Attainable sums are the bits of one integer; the item that first reached each sum leads back to the chosen ones. Items
    are taken in order of ``item`` (the size where none is named). Of one size no more items fit than capacity / size, so only
    the first so many reach a group's task: at most capacity * (1 + ln capacity) rows. Sizes over the capacity are left out.
    """
    item = item or size

    def run(rows: pd.DataFrame) -> tuple[int, list]:
        bits, mask = 1, (1 << (capacity + 1)) - 1
        reached: dict[int, tuple[int, object]] = {}  # sum -> size and item that first made it
        rows = rows[(rows["size_"] > 0) & (rows["size_"] <= capacity)].sort_values(["item_", "size_"])
        for s, x in zip(rows["size_"].astype(int).tolist(), rows["item_"].tolist(), strict=True):
            new = bits << s & mask & ~bits
            bits |= new
            while new:
                low = new & -new
                reached[low.bit_length() - 1] = s, x
                new ^= low
        filled = at = bits.bit_length() - 1
        chosen = []
        while at:
            s, x = reached[at]
            chosen.append(x)
            at -= s
        return filled, chosen[::-1]

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        filled, chosen = run(rows)
        return pd.DataFrame({**{k: [rows[k].iloc[0]] for k in keys}, "filled": [filled], "chosen": [chosen]})

    kinds = {f.name: f.dataType.simpleString() for f in items.schema.fields}
    fits = F.when(F.col(size).between(1, capacity), F.col(size))  # one row of the others stays, so that no group is lost
    rank = F.row_number().over(Window.partitionBy(*keys, "size_").orderBy("item_"))
    own = items.select(*keys, fits.alias("size_"), F.col(item).alias("item_")).withColumn("k_", rank)
    own = own.filter((F.col("k_") == 1) | (F.col("k_") * F.col("size_") <= capacity)).drop("k_")
    return own.groupBy(*keys).applyInPandas(group, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", filled long, chosen array<{kinds[item]}>")


def overlap(a: str, b: str) -> int:
    """Length of the longest end of a that b starts with."""
    for n in range(min(len(a), len(b)), 0, -1):
        if a.endswith(b[:n]):
            return n
    return 0


def merged_captions(df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Each entity's captions as one text; what a caption repeats of the text so far is dropped."""

    def step(said, row):
        said, t = said or "", row[0] or ""
        n = overlap(said[-len(t) :] if t else "", t)
        return said + (t[n:] if n or not said else " " + t), []

    return fold.folded(df, [key], [F.col(order), F.col(text)], [text], step, "text string", lambda said: [(said,)])
