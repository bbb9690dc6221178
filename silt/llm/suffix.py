"""Suffix dedup: bytes of strings of a given length that start at more than one place in the corpus.

All suffixes of the corpus would be many times its size, so suffixes are taken at anchors and carry what tells them
apart. The anchor of a string is the least-hashed run of ``GRAM`` bytes in it, so equal strings have equal anchors at
equal places; one anchor serves a run of neighbouring strings. Anchors whose run occurs once in the corpus are dropped:
no string over them repeats. For the others, strings are taken in chunks of up to ``CHUNK`` starts. A chunk's strings
share a core (all but ``CHUNK`` - 1 bytes); the suffix that starts at the core is one record. Its key is its leading
token of eight bytes and the 128-bit digest of the core, which stands for the bytes after the token; the wings, the
bytes on both sides of the core, follow.

Keys of a sample of records give the splitters: suffixes are range-partitioned by leading token, then digest, and every
bucket is sorted. Strings with equal cores are told apart by a multikey quicksort of their wings, a machine word at a time inside runs
that are equal so far; equal neighbours repeat. A splitter never falls between equal keys here.

A core that very many texts hold would meet in one bucket, so cores at the most common anchors go another way: equal
runs, inside each text and then of all texts, then equal records, are folded into one with a count before the shuffle, and
repeat whole; what is left of a contested core is taken apart into its strings, each a suffix of its own (key, place of
the core, wings). These are range-partitioned and sorted with splitters that may fall between equal ones; every bucket
compares neighbours and gives its first and last record, and those are compared across the boundaries.

Equal texts are one node: a text with copies repeats whole. Null texts are empty. Texts shorter than the length have no
strings. Matches never cross texts. Repeated rows count as copies. An empty table gives no rows. Results are exact up to
128-bit digests of cores.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silt.llm.common import discard, joined_by_weight, map_texts, mix64, stored

#: Bytes of a repeated string, and of one that counts as a passage: about 50 words.
LENGTH, PASSAGE = 400, 240
GRAM, CHUNK = 64, 33
PART = 1 << 19  # starts that are handled at once in a very long text
ROWS = 40_000  # records that are compared at once
SAMPLED = 10_000  # anchors, about, whose suffixes give the splitters; of more than 400 buckets, 25 for each
HOT_LEAST, HOT_MOST = 1000, 20_000  # an anchor of at most so many places is never hot; of more than so many, always

SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
SPANS = "array<struct<start:int,stop:int>>"


def grams(b: np.ndarray) -> np.ndarray:
    """Hashes of all runs of GRAM bytes, by doubling."""
    h = mix64(b.astype(np.uint64) + np.uint64(1))
    size, k = 1, 0
    while size < GRAM:
        k += 1
        h = h[:-size] * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64) + h[size:]
        size *= 2
    return mix64(h)


def anchors(raw: bytes, length: int, start: int = 0, stop: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first start, last start) of the anchors of one text, or of a part of it; every start has one anchor."""
    n = (len(raw) if stop is None else stop) - start - length + 1
    if n < 1:
        none = np.empty(0, np.int64)
        return none, none, none, none
    out = []
    width = length - GRAM + 1
    for s in range(start, start + n, PART):
        m = min(PART, start + n - s)
        h = grams(np.frombuffer(raw, np.uint8, m + length - 1, s))
        low = np.uint64(2**20 - 1)
        v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            v = np.minimum(v[:-size], v[size:])
            size *= 2
        v = np.minimum(v[:m], v[width - size : width - size + m])
        at = (v & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:] - 1, [m - 1]])
        out.append((h[at[first]].view(np.int64), at[first] + s, first + s, last + s))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def records(raw: bytes, runs: list[dict], length: int) -> Iterator[tuple[bytes, int, bytes, int, bool]]:
    """(leading token and core digest, core start, wings, length of the left wing, whether the run is folded) of each chunk of each anchor."""
    digest = xxhash.xxh3_128_digest
    for r in runs:
        q, lo, hi = r["pos"], r["lo"], r["hi"]
        for c in range((q - hi) // CHUNK, (q - lo) // CHUNK + 1):
            at = q - c * CHUNK
            first, last = max(lo, at - CHUNK + 1), min(hi, at)
            core = raw[at : at + length - CHUNK + 1]
            yield core[:8] + digest(core), at, raw[first:at] + raw[at + len(core) : last + length], at - first, r.get("folded", False)


def multikey_equal(code: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Whether each element equals another one in ``code`` and all ``words``.

    A multikey quicksort, all runs at once: elements are sorted by one key at a time, only inside runs that are equal so
    far, and elements that are alone leave.
    """
    out = np.zeros(len(code), bool)
    left, run = np.arange(len(code)), np.zeros(len(code), np.int64)
    for key in [code, *words]:
        k = key[left]
        order = np.lexsort((k, run))
        left, k, run = left[order], k[order], run[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (run[1:] != run[:-1])])
        ids = np.cumsum(new) - 1
        many = np.bincount(ids)[ids] > 1
        left, run = left[many], ids[many]
        if not len(left):
            return out
    out[left] = True
    return out


def compare(core: list[bytes], node: np.ndarray, at: np.ndarray, wings: list[bytes], left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, start, stop) of the bytes of strings that repeat among these records, which hold their cores whole."""
    group: dict[bytes, int] = {}
    g = np.array([group.setdefault(c, len(group)) for c in core], np.int64)
    # records that are the same throughout repeat whole; one of each kind goes on to meet the others
    kinds: dict[tuple, int] = {}
    kind = np.array([kinds.setdefault(k, i) for i, k in enumerate(zip(g.tolist(), left.tolist(), wings, strict=True))])
    alone = np.bincount(kind, minlength=len(kind))
    reps = np.flatnonzero(alone > 0)
    size = np.array([len(wings[i]) for i in reps]) - (CHUNK - 1) + 1  # strings of each
    base = np.cumsum([0, *(len(wings[i]) for i in reps)])[:-1]
    buf = np.frombuffer(b"".join(wings[i] for i in reps) + b"\0" * 8, np.uint8)
    word = np.zeros(len(buf) - 7, np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | buf[i : len(buf) - 7 + i]
    owner = np.repeat(np.arange(len(reps)), size)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    offset = base[owner] + k
    a = left[reps][owner] - k
    dup = multikey_equal(g[reps][owner] * CHUNK + a, [word[offset + 8 * i] for i in range((CHUNK - 1) // 8)])
    dup |= alone[reps][owner] > 1
    # flags of the representatives, given to all of their kind
    where = np.zeros(len(kind), np.int64)
    where[reps] = np.arange(len(reps))
    mine = where[kind]
    first = np.cumsum(size) - size
    any_dup = np.add.reduceat(dup, first)[mine] > 0
    rows = np.flatnonzero(any_dup)
    n = size[mine[rows]]
    idx = np.repeat(first[mine[rows]], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    row, start = np.repeat(rows, n), np.repeat((at - left)[rows], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    on = dup[idx]
    row, start = row[on], start[on]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)]) if len(row) else np.empty(0, bool)
    begin = np.flatnonzero(new)
    end = np.concatenate([begin[1:] - 1, [len(row) - 1]]) if len(begin) else begin
    return node[row[begin]], start[begin], start[end] + length


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def spread(batch: pa.RecordBatch, k: int) -> list[list[tuple[int, int]]]:
    """Column k, a list of spans, as tuples."""
    return [[(s["start"], s["stop"]) for s in found or ()] for found in batch.column(k).to_pylist()]


def emitter(length: int, column: int, splitters: list[bytes] | None = None) -> Callable:
    """Records of the runs in ``column`` beside node and text_; with splitters, the bucket of each."""
    kinds = {"key": pa.binary(), "at": pa.int32(), "wings": pa.binary(), "left": pa.int32(), "folded": pa.bool_(), "node": pa.int64()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(splitters or [], "S24")
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                rows = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(column).to_pylist(), strict=True)
                out = [(*r, n) for n, text, runs in rows if runs for r in records(text.encode("utf-8", "surrogatepass"), runs, length)]
                if not out:
                    continue
                cols = list(zip(*out, strict=True))
                arrays = {name: pa.array(c, t) for c, (name, t) in zip(cols, kinds.items(), strict=True)}
                if splitters is not None:
                    arrays["bucket"] = pa.array(np.searchsorted(edges, np.array(cols[0], "S24"), "right").astype(np.int32))
                yield pa.RecordBatch.from_pydict(arrays)

    return run


EMITTED = "key binary, at int, wings binary, left int, folded boolean, node long"
FOUND = "node long, start int, stop int"


def found_rows(node, start, stop) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], names=["node", "start", "stop"])


def in_buckets(held: DataFrame, length: int, n_runs: int) -> DataFrame:
    """(node, start, stop) of what repeats among the suffixes of the runs in ``runs``: sampled splitters, sorted buckets."""
    n = max(2, int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    some = F.expr(f"filter(runs, r -> pmod(xxhash64(node, r.pos), {max(1, n_runs // max(SAMPLED, 25 * n))}) = 0)")
    drawn = held.select("node", "text_", some.alias("runs")).filter("size(runs) > 0").mapInArrow(emitter(length, 2), EMITTED)
    sample = sorted(drawn.select("key").toArrow().column(0).to_pylist())  # of each anchor a few keys
    splitters = [sample[len(sample) * i // n] for i in range(1, n)] if sample else []

    def bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(t: pa.RecordBatch) -> pa.RecordBatch:
            col = {name: t.column(i) for i, name in enumerate(t.schema.names)}
            return found_rows(*compare(col["key"].to_pylist(), col["node"].to_numpy(), col["at"].to_numpy().astype(np.int64), col["wings"].to_pylist(), col["left"].to_numpy().astype(np.int64), length))

        for batch in batches:  # sorted by key; equal keys are never cut
            held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                last = whole.column(0)[whole.num_rows - 1]
                cut = int(np.argmax(pa.compute.equal(whole.column(0), last).to_numpy(zero_copy_only=False)))
                if cut:
                    yield done(whole.slice(0, cut))
                held = [whole.slice(cut)]
        if held:
            yield done(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    dealt = held.select("node", "text_", "runs").mapInArrow(emitter(length, 2, splitters), EMITTED + ", bucket int")
    return dealt.drop("folded").repartitionById(n, F.col("bucket")).sortWithinPartitions("key").drop("bucket").mapInArrow(bucket, FOUND)


def fold(rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Of records: (node, start, stop) of those that are the same throughout as others, and one of each kind whose core another kind shares."""
    kind = ["key", "left", "wings"]
    kinds = stored(rows.groupBy(*kind).agg(F.count("*").alias("n"), F.bool_or("folded").alias("folded"), F.min(F.struct("node", "at")).alias("one")), "hot-kinds")
    same = joined_by_weight(rows.filter("NOT folded").drop("folded"), stored(kinds.filter("n > 1").select(*kind, "n"), "hot-same"), kind, "n")
    contested = stored(kinds.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1"), "hot-cores")
    rivals = joined_by_weight(kinds, contested, ["key"], "k", "left_semi").select("key", "wings", "left", "one.node", "one.at", F.expr("folded OR n > 1 AS folded"))
    return same.select("node", F.expr("at - left AS start"), F.expr(f"at - left + length(wings) + {length - CHUNK + 1} AS stop")), rivals


FINE = 8


def finer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of up to ``FINE`` strings each, from records of more: what these strings share of the wings joins the key."""
    m = CHUNK - 1
    for batch in batches:
        for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
            out = []
            for key, wings, left, node, at, folded in zip(*(part.column(k).to_pylist() for k in range(6)), strict=True):
                least = left - (len(wings) - m)  # bytes left of the core in the last string; the first one has all
                for g in range(least // FINE, left // FINE + 1):
                    lo, hi = max(least, g * FINE), min(left, g * FINE + FINE - 1)
                    shared = wings[left - g * FINE : left + max(0, m - g * FINE - FINE + 1)]
                    out.append((key + bytes([g]) + shared, at, wings[left - hi : left - lo + m], hi, folded, node))
            cols = zip(*out, strict=True)
            types = (pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["key", "at", "wings", "left", "folded", "node"])


def strings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All strings of records (key, wings, left, node, at, folded): (suffix, node, start, many); folded ones repeat anyway."""
    for batch in batches:
        for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
            out = []
            for key, wings, left, node, at, folded in zip(*(part.column(k).to_pylist() for k in range(6)), strict=True):
                for j in range(len(wings) - CHUNK + 2):
                    out.append((key + bytes([left - j]) + wings[j : j + CHUNK - 1], node, at - left + j, folded))
            suffix, node, start, folded = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(suffix, pa.binary()), pa.array(node, pa.int64()), pa.array(start, pa.int32()), pa.array(folded, pa.bool_())], names=["suffix", "node", "start", "folded"])


def neighbours(length: int) -> Callable:
    """Of a sorted bucket of strings: those that equal a neighbour, and (with ``edge``, the string) the first and the last one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: pa.RecordBatch, on: np.ndarray, edge: bool) -> pa.RecordBatch:
            some = rows.filter(pa.array(on))
            start = some.column(2).to_numpy().astype(np.int64)
            edges = some.column(0) if edge else pa.nulls(some.num_rows, pa.binary())
            return pa.RecordBatch.from_arrays([some.column(1), some.column(2), pa.array(start + length, pa.int32()), edges], names=["node", "start", "stop", "edge"])

        last, open_ = None, True  # the row before this batch, and whether it is still without an equal
        for batch in batches:
            if not batch.num_rows:
                continue
            s = batch.column(0)
            same = pa.compute.equal(s.slice(1), s.slice(0, len(s) - 1)).to_numpy(zero_copy_only=False)
            joined = last is not None and last.column(0)[0].as_py() == s[0].as_py()
            on = np.zeros(len(s), bool)
            on[1:] |= same
            on[:-1] |= same
            on[0] |= joined
            if last is None:
                yield out(batch.slice(0, 1), np.ones(1, bool), True)
            elif joined and open_:
                yield out(last, np.ones(1, bool), False)
            yield out(batch, on & ~batch.column(3).to_numpy(zero_copy_only=False), False)
            last, open_ = batch.slice(batch.num_rows - 1, 1), not on[-1]
        if last is not None:
            yield out(last, np.ones(1, bool), True)

    return run


def of_hot_cores(held: DataFrame, length: int) -> DataFrame:
    """(node, start, stop) of what repeats among the suffixes of the runs in ``hot``, where a core may have any number of records."""

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text, runs in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                at: dict[bytes, list[dict]] = {}
                for r in runs:
                    at.setdefault(xxhash.xxh3_128_digest(raw[r["lo"] : r["hi"] + length]), []).append(r)
                own = [[{"start": a, "stop": b} for a, b in merged((r["lo"], r["hi"] + length) for r in same)] if len(same) > 1 else None for same in at.values()]
                first = [pa.array([same[0][c] for same in at.values()], pa.int32()) for c in ("pos", "lo", "hi")]
                cols = [pa.array([node] * len(at), pa.int64()), *first, pa.array(list(at), pa.binary()), pa.array(own, pa.list_(SPAN))]
                yield pa.RecordBatch.from_arrays(cols, names=["node", "pos", "lo", "hi", "digest", "own"])

    # runs that are the same throughout repeat whole; one of each kind goes on. A text's own repeats are found in the text, so a
    # run that it holds at many places is one row, with the spans of all of them
    hot = held.filter("hot IS NOT NULL")
    runs = stored(hot.select("node", "text_", "hot").mapInArrow(digests, f"node long, pos int, lo int, hi int, digest binary, own {SPANS}"), "hot-runs")
    kinds = stored(runs.groupBy("digest").agg(F.count("*").alias("n"), F.bool_or(F.col("own").isNotNull()).alias("own"), F.min(F.struct("node", "pos", "lo", "hi")).alias("one")), "hot-run-kinds")
    once = runs.filter("own IS NULL").drop("own")
    whole = joined_by_weight(once, stored(kinds.filter("n > 1").select("digest", "n"), "hot-whole"), ["digest"], "n").select("node", F.col("lo").alias("start"), (F.col("hi") + length).alias("stop"))
    whole = whole.unionByName(runs.filter("own IS NOT NULL").select("node", F.inline("own")))
    left = kinds.select("one.*", F.expr("own OR n > 1 AS folded")).groupBy("node").agg(F.collect_list(F.struct("pos", "lo", "hi", "folded")).alias("left"))
    # and so with their records, and then with finer ones
    rows = stored(hot.select("node", "text_").join(left, "node").select("node", "text_", "left").mapInArrow(emitter(length, 2), EMITTED), "hot-records")
    same, rivals = fold(rows, length)
    fine, rivals = fold(stored(rivals.mapInArrow(finer, EMITTED), "hot-fine"), length)
    whole = whole.unionByName(same).unionByName(fine)
    each = stored(rivals.mapInArrow(strings, "suffix binary, node long, start int, folded boolean"), "hot-strings")
    n = max(2, int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = each.repartitionByRange(n, "suffix", F.xxhash64("node", "start")).sortWithinPartitions("suffix")
    near = stored(ranged.mapInArrow(neighbours(length), FOUND + ", edge binary"), "hot-found")
    edges = near.filter("edge IS NOT NULL")  # two a bucket
    across = edges.groupBy("edge").agg(F.collect_set(F.struct("node", "start", "stop")).alias("at")).filter("size(at) > 1").select(F.inline("at"))
    return whole.unionByName(near.filter("edge IS NULL").select("node", "start", "stop")).unionByName(across)


def spans_of(each: DataFrame, texts: Callable[[DataFrame], DataFrame], length: int) -> DataFrame:
    """(node, text_, spans) of texts with strings that repeat, stored; spans are ascending, apart, in bytes.

    ``each`` has an anchor in a row (node, gram, pos, lo, hi); ``texts`` gives (node, text_) of the nodes that it is asked for.
    """
    often = stored(each.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"), "grams")
    total = often.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > min(HOT_MOST, max(HOT_LEAST, total // 1000))  # so the records of one core in one task have a bound
    met = joined_by_weight(each, often, ["gram"], "n").withColumn("hot_", hot)
    run = F.struct("pos", "lo", "hi")
    runs = met.groupBy("node").agg(F.collect_list(F.when(~F.col("hot_"), run)).alias("runs"), F.collect_list(F.when(F.col("hot_"), run)).alias("hot"))
    runs = runs.withColumn("hot", F.when(F.size("hot") > 0, F.col("hot")))
    held = stored(texts(runs), "texts")
    found = in_buckets(held, length, total)
    if not often.filter(hot).isEmpty():
        found = found.unionByName(of_hot_cores(held, length))
    spans = found.groupBy("node").agg(F.collect_list(F.struct("start", "stop")).alias("found"))

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"start": a, "stop": b} for a, b in merged(found)] for found in spread(batch, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(SPAN))], names=["node", "text_", "spans"])

    out = stored(held.select("node", "text_").join(spans, "node").select("node", "text_", "found").mapInArrow(join, f"node long, text_ string, spans {SPANS}"), "spans")
    discard(held)
    return out


def texts_and_spans(df: DataFrame, id_col: str, text_col: str, length: int) -> tuple[DataFrame, DataFrame]:
    """All distinct texts (node, key, copies, n_bytes, sha), and those with strings that repeat in other texts or places (node, text_, spans).

    ``key`` is the text's MD5, ``sha`` its SHA-256.
    """
    own = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text_")).withColumn("key", F.unhex(F.md5("text_")))

    def first_pass(texts: list[str]) -> dict[str, list]:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        found = [anchors(b, length) for b in raw]
        out = {k: [f[i] for f in found] for i, k in enumerate(("gram", "pos", "lo", "hi"))}
        return out | {"n_bytes": list(map(len, raw)), "sha": [hashlib.sha256(b).hexdigest() for b in raw]}

    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    fields = {"gram": longs, "pos": ints, "lo": ints, "hi": ints, "n_bytes": pa.int64(), "sha": pa.string()}
    kind = df.schema[id_col].dataType.simpleString()
    passed = map_texts(own, ["id", "key"], "text_", first_pass, fields, f"id {kind}, key binary, gram array<long>, pos array<int>, lo array<int>, hi array<int>, n_bytes long, sha string")
    every = passed.groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in fields])
    wide = stored(every.withColumn("node", F.monotonically_increasing_id()), "anchors")
    nodes = stored(wide.select("node", "key", "first_id", "copies", "n_bytes", "sha"), "nodes")

    def texts(runs: DataFrame) -> DataFrame:
        wanted = runs.join(nodes.select("node", "key", "first_id"), "node")
        rows = own.join(wanted, (own["key"] == wanted["key"]) & own["id"].eqNullSafe(wanted["first_id"]))
        return rows.select("node", "text_", "runs", "hot").dropDuplicates(["node"])

    spans = spans_of(wide.select("node", F.inline(F.arrays_zip("gram", "pos", "lo", "hi"))), texts, length)
    discard(wide)
    return nodes, spans


def longer(spans: DataFrame, length: int) -> DataFrame:
    """What repeats at a greater length, from what repeats at a smaller one: a longer string lies inside one of the spans."""

    def again(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, text, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), spread(batch, 2), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                found = [anchors(raw, length, a, b) for a, b in parts if b - a >= length]
                if found:
                    gram, pos, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
                    cols = [pa.array(np.full(len(gram), n)), pa.array(gram), *(pa.array(x, pa.int32()) for x in (pos, lo, hi))]
                    yield pa.RecordBatch.from_arrays(cols, names=["node", "gram", "pos", "lo", "hi"])

    each = stored(spans.mapInArrow(again, "node long, gram long, pos int, lo int, hi int"), "anchors")
    out = spans_of(each, lambda runs: spans.select("node", "text_").join(runs, "node").select("node", "text_", "runs", "hot"), length)
    discard(each)
    return out


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def kept_text(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the whole characters that spans cover."""
    raw = text.encode("utf-8", "surrogatepass")
    inner = []
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        inner.append((a, b))
    return kept_bytes(raw, inner).decode("utf-8", "surrogatepass")


def repeats(df: DataFrame, id_col: str, text_col: str, length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """(``id_col``, n_bytes, n_removed, n_spans, kept_sha256, n_passage_bytes) for every row of ``df``.

    Bytes under repeated strings of ``length`` bytes are removed. The last column counts the bytes under repeated strings of
    ``passage`` bytes (at most ``length``), which finds shorter passages too and removes nothing.
    """
    nodes, shorter = texts_and_spans(df, id_col, text_col, passage)
    spans = longer(shorter, length)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, pairs = batch.column(1).to_pylist(), spread(batch, 2)
            cols = [
                batch.column(0),
                pa.array([sum(b - a for a, b in p) for p in pairs], pa.int64()),
                pa.array([len(p) for p in pairs], pa.int64()),
                pa.array([hashlib.sha256(kept_bytes(t.encode("utf-8", "surrogatepass"), p)).hexdigest() for t, p in zip(texts, pairs, strict=True)]),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["node", "removed", "runs", "kept"])

    some = spans.mapInArrow(cut, "node long, removed long, runs long, kept string")
    under = shorter.select("node", F.expr("aggregate(spans, 0L, (n, s) -> n + s.stop - s.start) AS under"))
    many = lambda n: F.expr(f"copies > 1 AND n_bytes >= {n}")
    whole = many(length)
    each = nodes.join(some, "node", "left").join(under, "node", "left").select(
        "key", "copies", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        F.when(many(passage), F.col("n_bytes")).otherwise(F.coalesce("under", F.lit(0))).alias("n_passage_bytes"),
    )
    rows = df.select(id_col, F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("key"))
    return joined_by_weight(rows, stored(each, "found"), ["key"], "copies").select(id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes")


def without_repeats(df: DataFrame, id_col: str, text_col: str, length: int = LENGTH) -> DataFrame:
    """``df`` with the repeated bytes cut out of its texts, where they make whole characters; untouched texts stay as they are."""
    nodes, spans = texts_and_spans(df, id_col, text_col, length)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [kept_text(t, p) for t, p in zip(batch.column(1).to_pylist(), spread(batch, 2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], names=["node", "new_"])

    some = spans.mapInArrow(cut, "node long, new_ string")
    once = some.join(nodes.filter("copies = 1").select("node", "key"), "node").select("key", "new_", F.lit(1).cast("long").alias("copies"))
    changed = once.unionByName(nodes.filter(f"copies > 1 AND n_bytes >= {length}").select("key", F.lit("").alias("new_"), "copies"))
    rows = df.select(F.struct("*").alias("row"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("key"))
    joined = joined_by_weight(rows, stored(changed, "changed"), ["key"], "copies", "left")
    return joined.select(*[F.coalesce("new_", F.col(f"row.`{c}`")).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in df.columns])
