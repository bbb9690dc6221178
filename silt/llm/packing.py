"""Best-fit packing planned on the histogram of lengths.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens (only documents that are longer are cut;
the first piece takes the odd rest). The plan is best-fit decreasing over (length, count) pairs, so its cost depends
on ``capacity`` and not on the number of documents: sequences with equal space left are one group. Pieces then take
their slots by a join on their rank within their length.

Ranks are dealt in two steps, over hashed buckets within a length and then within a bucket, so that a length that a
third of all pieces share does not meet in one task.

Null and empty texts are one piece with the end token alone. Repeated rows are packed separately. An empty table has
no pieces.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from silt.llm.common import map_texts, stored

BUCKETS = 256
PIECE = pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("crc", pa.int64()), ("ids", pa.binary())])


@lru_cache(maxsize=2)
def library(path: str) -> tokenizers.Tokenizer:
    return tokenizers.Tokenizer.from_file(path)


def token_ids(text: str, path: str, pattern: str) -> list[int]:
    """Ids of a text of any length. Where a run is so long that the fast encoder's pattern gives up, the tokenizers library gives them."""
    try:
        return encoder(path, pattern).encode(text, allowed_special="all")
    except ValueError:
        return library(path).encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    """The vocabulary of a byte-level tokenizer file; gives the ids that the tokenizers library gives, in a fifth of its time.

    Added tokens are found in texts as that library finds them.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)


def cut(ids: np.ndarray, capacity: int, with_ids: bool) -> list[dict]:
    """The pieces of one document."""
    n = len(ids)
    rest = n % capacity if n > capacity else n
    at = [0, *range(rest, n, capacity)] if rest else list(range(0, n, capacity))
    out = []
    for k, a in enumerate(at):
        b = at[k + 1] if k + 1 < len(at) else n
        raw = ids[a:b].tobytes()
        out.append({"piece": k, "start": a, "length": b - a, "crc": zlib.crc32(raw), "ids": raw if with_ids else None})
    return out


def pieces(df: DataFrame, id_col: str, text_col: str, path: str, pattern: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """(``id_col``, piece, start, length, crc, ids): ids are little-endian unsigned 32-bit, null unless asked for."""

    def fn(texts: list[str]) -> dict[str, list]:
        return {"p": [cut(np.array([*token_ids(t, path, pattern), end_id], "<u4"), capacity, with_ids) for t in texts]}

    kind = df.schema[id_col].dataType.simpleString()
    out = map_texts(df, [id_col], text_col, fn, {"p": pa.list_(PIECE)}, f"`{id_col}` {kind}, p array<struct<piece:int,start:bigint,length:int,crc:bigint,ids:binary>>")
    return out.select(id_col, F.inline("p"))


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, pieces, pieces a sequence, first sequence, offset): best-fit decreasing over counts.

    There are at most two new groups of sequences a length, so the plan is bounded by ``capacity``, whatever the counts.
    """
    out: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # space left -> runs (first sequence, how many)
    spaces: list[int] = []
    used = 0

    def put_back(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in room:
                room[space] = []
                insort(spaces, space)
            room[space].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def fill(space: int, first: int, n: int) -> int:
            """Fill up to n sequences of this space; how many are touched."""
            nonlocal left, rank
            each = space // length
            whole = min(n, left // each)
            for seqs, per in ((whole, each), (1 if whole < n else 0, left - whole * each)):
                if seqs and per > 0:
                    out.append((length, rank, seqs * per, per, first, capacity - space))
                    put_back(space - per * length, first, seqs)
                    left, rank, first = left - seqs * per, rank + seqs * per, first + seqs
                    whole = whole + 1 if per != each or seqs != whole else whole
            return min(whole, n)

        while left and (at := bisect_left(spaces, length)) < len(spaces):
            space = spaces[at]
            runs = room.pop(space)
            del spaces[at]
            while runs:
                first, n = runs.pop()
                touched = fill(space, first, n) if left else 0
                put_back(space, first + touched, n - touched)
                if not left:
                    for run in runs:
                        put_back(space, *run)
                    break
        if left:
            new = -(-left // (capacity // length))
            fill(capacity, used, new)
            used += new
    return out


def pack(cut_up: DataFrame, id_col: str, capacity: int) -> DataFrame:
    """``cut_up`` (from ``pieces``) with sequence_id and offset."""
    spark = cut_up.sparkSession
    placed = cut_up.withColumn("bucket", F.expr(f"CAST(pmod(xxhash64(`{id_col}`, piece, crc), {BUCKETS}) AS int)"))
    dealt = placed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = dealt.withColumn("skipped", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    counts = {r[0]: r[1] for r in dealt.groupBy("length").agg(F.sum("n")).collect()}  # a row for each length, so at most `capacity`
    slots = spark.createDataFrame(plan(counts, capacity), "length int, first_rank long, n_slots long, per long, first_seq long, at long")
    order = Window.partitionBy("length", "bucket").orderBy(id_col, "piece", "crc")
    ranked = placed.withColumn("rn", F.row_number().over(order) - 1)
    # at most capacity * BUCKETS rows, and a plan bounded by capacity: both are safe to broadcast
    ranked = ranked.join(F.broadcast(before.select("length", "bucket", "skipped")), ["length", "bucket"]).withColumn("rank", F.col("rn") + F.col("skipped"))
    inside = (ranked["length"] == slots["length"]) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n_slots"))
    joined = ranked.join(F.broadcast(slots), inside).drop(slots["length"])
    k = F.col("rank") - F.col("first_rank")
    return joined.select(
        id_col, "piece", "start", F.col("length").cast("long").alias("length"), F.col("crc").alias("ids_crc32"),
        (F.col("first_seq") + F.floor(k / F.col("per"))).alias("sequence_id"), (F.col("at") + (k % F.col("per")) * F.col("length")).alias("offset"),
    )


def pack_documents(df: DataFrame, id_col: str, text_col: str, path: str, pattern: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Cut and pack; the cut pieces (numbers only) are stored, so texts are tokenised once."""
    return pack(stored(pieces(df, id_col, text_col, path, pattern, end_id, capacity).drop("ids"), "pieces"), id_col, capacity)
