"""Byte-level BPE in two tiers: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest.

Tier one is a hash-and-displace minimal perfect hash over the vocabulary: every token has a slot of its own and no
slot is empty, so a pre-token is in the vocabulary exactly if the token in its slot has the same bytes. Tier two
merges a missing pre-token by rank: byte positions form a linked list (``end[i]`` is where the piece that starts at
``i`` ends), and a heap yields the lowest-ranked adjacent pair, leftmost first.

Null texts count as empty and have no ids. Texts of any length are worked on whole.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
import xxhash
from pyspark.sql import DataFrame

from silt.llm.common import map_texts, mix64

#: Memoised pre-tokens per worker, and the longest one (in characters) that is memoised.
MEMO, MEMO_CHARS = 700_000, 48


class PerfectHash:
    """slot(key) for a fixed set of byte strings: a bijection onto range(n)."""

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.n_buckets = max(1, n // 3)
        self.shift = np.zeros(self.n_buckets, np.uint64)
        h = self._hash(keys)
        bucket = (h % np.uint64(self.n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(self.n_buckets + 1))
        taken = np.zeros(n, bool)
        self.keys: list[bytes] = [b""] * n
        self.values = np.zeros(n, np.int64)
        for b in np.argsort(first[:-1] - first[1:], kind="stable"):
            members = order[first[b] : first[b + 1]]
            if not len(members):
                break
            d = 0
            while True:  # displacements are tried in turn until all members land on free slots
                tries = np.arange(d, d + 256, dtype=np.uint64)
                slots = (mix64(h[members][None, :] + (tries[:, None] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)
                fits = ~taken[slots].any(axis=1)
                if len(members) > 1:
                    s = np.sort(slots, axis=1)
                    fits &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                if fits.any():
                    k = int(np.argmax(fits))
                    break
                d += 256
            self.shift[b] = d + k
            taken[slots[k]] = True
            for m, s in zip(members, slots[k], strict=True):
                self.keys[s], self.values[s] = keys[m], m

    @staticmethod
    def _hash(keys: Iterable[bytes]) -> np.ndarray:
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter((digest(k) for k in keys), np.uint64)

    def slots(self, keys: list[bytes]) -> list[int]:
        h = self._hash(keys)
        d = self.shift[(h % np.uint64(self.n_buckets)).astype(np.int64)]
        return (mix64(h + (d + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64).tolist()


class Codec:
    """Encoder and decoder over a rank file (base64 token, rank) and a pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        tokens = list(self.ranks)
        self.hash = PerfectHash(tokens)
        self.slot_ids = [self.ranks[k] for k in self.hash.keys]
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}
        self.tokens = pa.array([self.bytes_of.get(i) for i in range(max(self.bytes_of, default=-1) + 1)], pa.binary())

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Ids of one pre-token that is not itself a token."""
        rank, n = self.ranks.get, len(word)
        pop, push = heapq.heappop, heapq.heappush
        end, before = list(range(1, n + 1)) + [0], list(range(-1, n))
        bits = n.bit_length()
        mask = (1 << bits) - 1  # an entry is rank, start of the left piece, end of the right one
        heap = [(r << bits | i) << bits | i + 2 for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            entry = pop(heap)
            e, i = entry & mask, entry >> bits & mask
            j = end[i]
            if not j or j >= n or end[j] != e:
                continue  # one of the two pieces has merged since
            end[i], end[j] = e, 0
            if e < n:
                before[e] = i
                r = rank(word[i : end[e]])
                if r is not None:
                    push(heap, (r << bits | i) << bits | end[e])
            p = before[i]
            if p >= 0:
                r = rank(word[p:e])
                if r is not None:
                    push(heap, (r << bits | p) << bits | e)
        ids, i, of = [], 0, self.ranks
        while i < n:
            j = end[i]
            ids.append(of[word[i:j]])
            i = j
        return tuple(ids)

    def learn(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of pre-tokens, as little-endian 32-bit values: whole tokens by their slot, others by merging."""
        words = list(words)
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        keys, ids = self.hash.keys, self.slot_ids
        found = [(ids[s],) if keys[s] == b else self.merge(b) for b, s in zip(raw, self.hash.slots(raw), strict=True)]
        return {w: struct.pack(f"<{len(f)}i", *f) for w, f in zip(words, found, strict=True)}

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit values."""
        parts = [self.split(t) for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        fresh = self.learn(set(chain.from_iterable(parts)).difference(self.memo))
        self.memo.update(fresh)
        out = [b"".join(map(self.memo.__getitem__, p)) for p in parts]
        for w in fresh:
            if len(w) > MEMO_CHARS:
                del self.memo[w]
        return out

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(b, "<i4").tolist() for b in self.encode_packed(texts)]

    def decode_arrays(self, ids: pa.ListArray) -> pa.BinaryArray:
        """The bytes of each list of ids (null: none): tokens are taken in a row, and their ends give the texts' ends."""
        lengths = pa.compute.fill_null(pa.compute.list_value_length(ids), 0)
        token = self.tokens.take(ids.flatten())
        if token.null_count:
            raise ValueError("an id stands for no token")
        ends = np.concatenate([[0], np.cumsum(lengths.to_numpy(zero_copy_only=False))])
        if not len(token):
            return pa.array([b""] * len(ids), pa.binary())
        _, offsets, data = token.buffers()
        at = np.frombuffer(offsets, "<i4")[token.offset : token.offset + len(token) + 1]
        return pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(at[ends].astype("<i4").tobytes()), data])

    def decode(self, ids: Iterable[int]) -> bytes:
        return self.decode_arrays(pa.array([list(ids)], pa.list_(pa.int32())))[0].as_py()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One per worker process."""
    return Codec(path, pattern)


def encode(df: DataFrame, id_col: str, text_col: str, path: str, pattern: str) -> DataFrame:
    """(``id_col``, ids array<int>) for every row; repeated rows stay repeated."""

    def fn(texts: list[str]) -> dict[str, list]:
        packed = codec(path, pattern).encode_packed(texts)
        ends = np.cumsum([0, *map(len, packed)], dtype=np.int32) // 4
        return {"ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))}

    return map_texts(df, [id_col], text_col, fn, {"ids": pa.list_(pa.int32())}, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, id_col: str, path: str, pattern: str) -> DataFrame:
    """``df`` of (``id_col``, ids) with a column ``decoded``, the bytes of the ids (null ids: no bytes)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = codec(path, pattern).decode_arrays(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), out], names=[id_col, "ids", "decoded"])

    return df.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids array<int>, decoded binary")
