"""Line dedup that can be taken back: sharded cuckoo filters over an exact table of reference counts.

A line's key is the line without blanks at its ends and with A-Z in lower case; keys of fewer than ``LEAST`` code points are
never compared. An index holds three kinds of tables in the shared folder:

- postings: (key, id), one for each document and key, where a key is a 128-bit digest;
- counts: for each key the number of its postings and its least and greatest document. Every insertion adds a segment of
  counts of its own; segments add up, so what is there is not written again;
- filters: one cuckoo filter a shard, with a 16-bit fingerprint for each key that has a posting. A shard is a range of
  digests; shards grow in number with the keys, so a filter has a bounded size.

An insertion asks the filters about its keys, already counted per key. What they do not know is new and goes straight into
the filter; the others (few, but for keys that are known) are looked up in the counts, and false alarms go into the filter
too, so every key of the index has exactly one fingerprint. Therefore a deletion can take the fingerprint of a key away
when its last posting goes, and counts its other keys anew from the postings that are left. A deleted document's lines come
back in the next one that holds them.

A key that documents of two ids or more hold is repeated: the document of the least id keeps its lines, the others lose
theirs. Null texts are one empty line. Rows with equal ids are one document (each keeps what the document keeps). A null id
is a document that comes after all others. An empty table gives no rows. Work is by digests, which hot keys do not gather
in one task: keys are counted before they are shuffled, and joins send hot keys past a broadcast of a bounded number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from silt.llm.common import SLICE_ROWS, batch_of, joined_by_weight, map_texts, mix64, stored

# What is stripped from lines, and the code points of the shortest key that counts.
BLANKS, LEAST = b" \t\n\x0b\x0c\r", 10

SLOTS, BITS = 4, 15  # of a filter: 2**BITS buckets of SLOTS fingerprints
FULL = int((1 << BITS) * SLOTS * 0.8)  # keys of a shard, on average, before shards are split
KICKS = 500


class Cuckoo:
    """A cuckoo filter over 64-bit hashes, with a stash for what finds no place: no insertion ever fails."""

    def __init__(self, raw: bytes | None = None, bits: int = BITS):
        if raw is None:
            self.bits, self.slots, self.stash = bits, np.zeros((1 << bits, SLOTS), np.uint16), []
        else:
            self.bits = raw[0]
            size = 2 * SLOTS << self.bits
            self.slots = np.frombuffer(raw, "<u2", size // 2, 1).reshape(-1, SLOTS).astype(np.uint16)
            self.stash = [tuple(x) for x in np.frombuffer(raw, "<u4", offset=1 + size).reshape(-1, 2).tolist()]

    def to_bytes(self) -> bytes:
        return bytes([self.bits]) + self.slots.astype("<u2").tobytes() + np.array(self.stash, "<u4").tobytes()

    def _of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint and first bucket."""
        fp = np.maximum(h & np.uint64(0xFFFF), np.uint64(1))
        return fp.astype(np.uint16), ((h >> np.uint64(16)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def _other(self, fp: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (mix64(fp.astype(np.uint64)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def contains(self, h: np.ndarray) -> np.ndarray:
        fp, a = self._of(h)
        on = (self.slots[a] == fp[:, None]).any(axis=1) | (self.slots[b := self._other(fp, a)] == fp[:, None]).any(axis=1)
        if self.stash:
            held = set(self.stash)
            on |= np.array([(f, x) in held or (f, y) in held for f, x, y in zip(fp.tolist(), a.tolist(), b.tolist(), strict=True)], bool)
        return on

    def _placed(self, fp: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Put fingerprints into free slots of their buckets; which of them found one."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.empty(0, np.int64)
        rank = np.arange(len(b)) - np.repeat(first, np.diff(np.append(first, len(b))))
        at = (self.slots[b] != 0).sum(axis=1) + rank  # slots are filled from the left
        on = at < SLOTS
        self.slots[b[on], at[on]] = fp[order[on]]
        out = np.zeros(len(fp), bool)
        out[order[on]] = True
        return out

    def insert(self, h: np.ndarray) -> None:
        fp, a = self._of(h)
        left = ~self._placed(fp, a)
        fp, a = fp[left], a[left]
        b = self._other(fp, a)
        left = ~self._placed(fp, b)
        for f, at in zip(fp[left].tolist(), b[left].tolist(), strict=True):
            self._kick(f, at)

    def _kick(self, f: int, at: int) -> None:
        for k in range(KICKS):
            row = self.slots[at]
            free = np.flatnonzero(row == 0)
            if len(free):
                row[free[0]] = f
                return
            f, row[k % SLOTS] = int(row[k % SLOTS]), f
            at = int(self._other(np.array([f], np.uint16), np.array([at]))[0])
        self.stash.append((f, at))

    def remove(self, h: np.ndarray) -> None:
        """Take one fingerprint of each hash away; every hash has been inserted before."""
        fp, a = self._of(h)
        for f, *ways in zip(fp.tolist(), a.tolist(), self._other(fp, a).tolist(), strict=True):
            for at in ways:
                row = self.slots[at]
                hit = np.flatnonzero(row == f)
                if len(hit):
                    n = int((row != 0).sum()) - 1
                    row[hit[0]], row[n] = row[n], 0
                    break
            else:
                self.stash.remove(next((f, at) for at in ways if (f, at) in self.stash))


def keys_of(text: str) -> list[bytes | None]:
    """The digest of each line's key; None for short ones."""
    out: list[bytes | None] = []
    for line in text.encode("utf-8", "surrogatepass").lower().split(b"\n"):  # lower: of A-Z only
        key = line.strip(BLANKS)
        on = len(key) >= 4 * LEAST or (len(key) >= LEAST and len(key.decode("utf-8", "surrogatepass")) >= LEAST)
        out.append(xxhash.xxh3_128_digest(key) if on else None)
    return out


def postings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key): the distinct keys of each row."""

    def fn(texts: list[str]) -> dict[str, list]:
        return {"keys": [list({k for k in keys_of(t) if k}) for t in texts]}

    kind = df.schema[id_col].dataType.simpleString()
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_texts(own, ["id"], "text", fn, {"keys": pa.list_(pa.binary())}, f"id {kind}, keys array<binary>").select("id", F.explode("keys").alias("key"))


def shard_of(bits: int) -> Column:
    """The leading bits of the digest."""
    return F.expr(f"CAST(conv(hex(substring(key, 1, 4)), 16, 10) AS bigint) >> {32 - bits}").cast("int")


def hashes(keys: pa.ChunkedArray) -> np.ndarray:
    """64 bits of each digest that do not hold the shard's."""
    raw = b"".join(keys.to_pylist())
    return np.frombuffer(raw, "<u8").reshape(-1, 2)[:, 1] if raw else np.empty(0, np.uint64)


def counts_of(rows: DataFrame) -> DataFrame:
    """(key, refs, least, greatest, loose) of postings; loose: a document without id holds the key."""
    return rows.groupBy("key").agg(F.count("*").alias("refs"), F.min("id").alias("least"), F.max("id").alias("greatest"), F.bool_or(F.col("id").isNull()).alias("loose"))


@dataclass(frozen=True)
class LineIndex:
    """Tables of an index. Those of an older state stay as they are when a new one is made."""

    postings: tuple[DataFrame, ...]
    counts: tuple[DataFrame, ...]
    filters: DataFrame
    bits: int  # of the shard number
    keys: int  # at most so many are in the filters


def _union(parts: tuple[DataFrame, ...]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _built(keys: DataFrame, bits: int) -> DataFrame:
    """(shard, filter) of distinct keys."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        made = Cuckoo()
        made.insert(hashes(table["key"]))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([made.to_bytes()], pa.binary())})

    return stored(keys.select("key", shard_of(bits).alias("shard")).groupBy("shard").applyInArrow(build, "shard int, filter binary"), "filters")


def _bits(keys: int) -> int:
    return max(0, (max(keys, 1) - 1) // FULL).bit_length()


def _through(keys: DataFrame, filters: DataFrame, bits: int, what: str) -> DataFrame:
    """Send distinct keys through their shards' filters; (shard, key, filter), a row for each answer and for each filter.

    ``what``: "ask" gives the keys that may be known, "learn" does so and puts the others in, "add" puts all in and "remove"
    takes all out. Filters come with all but "ask".
    """

    def run(shard: tuple, table: pa.Table, held: pa.Table) -> pa.Table:
        filter_ = Cuckoo(held["filter"][0].as_py()) if held.num_rows else Cuckoo()
        h = hashes(table["key"])
        known = filter_.contains(h) if what in ("ask", "learn") else np.zeros(len(h), bool)
        if what == "remove":
            filter_.remove(h)
        elif what != "ask":
            filter_.insert(h[~known])
        found = table["key"].filter(pa.array(known)).to_pylist()
        after = [] if what == "ask" else [filter_.to_bytes()]
        n = len(found) + len(after)
        return pa.table({"shard": pa.array([shard[0].as_py()] * n, pa.int32()), "key": pa.array(found + [None] * len(after), pa.binary()), "filter": pa.array([None] * len(found) + after, pa.binary())})

    mine = keys.select("key", shard_of(bits).alias("shard"))
    return mine.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(run, "shard int, key binary, filter binary")


def _answers(sent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys, and (shard, filter), of a stored ``_through``."""
    return sent.filter("key IS NOT NULL").select("key"), sent.filter("filter IS NOT NULL").select("shard", "filter")


def empty(df: DataFrame, id_col: str) -> LineIndex:
    """An index without documents, for ids such as those of ``df``."""
    none = df.select(F.col(id_col).alias("id"), F.lit(b"").alias("key")).limit(0)
    return LineIndex((none,), (counts_of(none),), none.sparkSession.createDataFrame([], "shard int, filter binary"), 0, 0)


def counted(index: LineIndex, keys: DataFrame | None = None) -> DataFrame:
    """(key, refs, least, greatest, loose) of all keys, or of those that ``keys`` has."""
    rows = _union(index.counts)
    rows = rows if keys is None else rows.join(keys.select("key"), "key", "left_semi")
    return rows.groupBy("key").agg(F.sum("refs").alias("refs"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.bool_or("loose").alias("loose"))


def lookup(index: LineIndex, keys: DataFrame) -> DataFrame:
    """What ``counted`` gives for distinct ``keys``: the filters rule most unknown ones out, the counts decide on the others."""
    return counted(index, _through(keys, index.filters, index.bits, "ask"))


def insert(index: LineIndex, new: DataFrame) -> LineIndex:
    """The index with ``new`` postings, a stored table, of documents that it does not have."""
    fresh = stored(counts_of(new), "counts")
    n = fresh.count()
    after = replace(index, postings=(*index.postings, new), counts=(*index.counts, fresh), keys=index.keys + n)
    if after.keys > FULL << index.bits or index.keys == 0:  # more shards, with room for as many keys again
        bits = _bits(2 * after.keys)
        return replace(after, bits=bits, filters=_built(counted(after), bits))
    maybe, filters = _answers(stored(_through(fresh, index.filters, index.bits, "learn"), "asked"))
    known = stored(counted(index, maybe).select("key"), "known")
    false = stored(maybe.join(known, "key", "left_anti"), "false-alarms")
    if not false.isEmpty():
        filters = _answers(stored(_through(false, filters, index.bits, "add"), "filters"))[1]
    return replace(after, filters=filters, keys=after.keys - known.count())


def remove(index: LineIndex, ids: DataFrame) -> LineIndex:
    """The index without the documents whose id is in the only column of ``ids``."""
    held = _union(index.postings)
    gone_ids = ids.select(F.col(ids.columns[0]).alias("gone_")).distinct()
    same = held["id"].eqNullSafe(gone_ids["gone_"])
    left = stored(held.join(gone_ids, same, "left_anti"), "postings")
    touched = stored(held.join(gone_ids, same, "left_semi").groupBy("key").agg(F.count("*").alias("uses")), "touched")
    anew = stored(counts_of(left.join(touched.select("key"), "key", "left_semi")), "counts")
    rest = stored(counted(index).join(touched.select("key"), "key", "left_anti").unionByName(anew), "counts")
    last = stored(touched.select("key").join(anew.select("key"), "key", "left_anti"), "last")
    filters = _answers(stored(_through(last, index.filters, index.bits, "remove"), "filters"))[1]
    return replace(index, postings=(left,), counts=(rest,), filters=filters, keys=index.keys - last.count())


def repeated(counts: DataFrame) -> DataFrame:
    """Of ``counted`` rows, (key, refs, least): those of keys that several documents hold."""
    return counts.filter("least <> greatest OR (loose AND least IS NOT NULL)").select("key", "refs", "least")


def lost_keys(index: LineIndex) -> DataFrame:
    """(id, lost): for each document of the index that loses lines, their keys."""
    again = stored(repeated(counted(index)), "repeated")
    rows = joined_by_weight(_union(index.postings), again, ["key"], "refs")
    return rows.filter(~F.col("id").eqNullSafe(F.col("least"))).groupBy("id").agg(F.collect_set("key").alias("lost"))


def cut(text: str, lost: set[bytes]) -> tuple[int, int, str]:
    """(lines, lines dropped, text that is kept)."""
    lines = text.split("\n")
    if not lost:
        return len(lines), 0, text
    kept = [line for line, key in zip(lines, keys_of(text), strict=True) if key not in lost]
    return len(lines), len(lines) - len(kept), "\n".join(kept)


def index_of(df: DataFrame, id_col: str, text_col: str, batches: int = 2) -> LineIndex:
    """All documents, put into an empty index in so many increments of about equal size; any number gives the same index."""
    all_ = stored(postings(df, id_col, text_col), "postings")
    index = empty(df, id_col)
    for k in range(batches):
        index = insert(index, all_.filter(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(batches)) == k))
    return index


def applied(df: DataFrame, id_col: str, text_col: str, index: LineIndex, with_text: bool = True) -> DataFrame:
    """(``id_col``, n_lines, n_dropped, kept_sha256, kept_text) for every row of ``df``, whose documents the index has; the text is null unless asked for."""
    lost = lost_keys(index)
    rows = df.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"))
    both = rows.join(lost, rows["id_"].eqNullSafe(lost["id"]), "left").select("id_", "text_", "lost")
    kind = StructType([StructField(id_col, df.schema[id_col].dataType), StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("kept_sha256", StringType()), StructField("kept_text", StringType())])
    schema = to_arrow_schema(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, SLICE_ROWS) for i in range(0, batch.num_rows, SLICE_ROWS)):
                out = []
                for i, text, lost in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    n, dropped, kept = cut(text or "", set(lost or ()))
                    out.append((i, n, dropped, hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest(), kept if with_text else None))
                yield batch_of(out, schema)

    return both.mapInArrow(run, kind)


def deduplicated(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(``id_col``, n_lines, n_dropped, kept_sha256) for every row of ``df``."""
    return applied(df, id_col, text_col, index_of(df, id_col, text_col), with_text=False).drop("kept_text")
