"""Phrase collocations by suffix-sigma: counts of all word runs up to a length from one sort of truncated suffixes.

Words are numbered by 64 bits of a digest of language and word; 0 ends a piece. A first pass counts the words: it gives the
words behind the numbers, the size of each language and, from a sample of the places, the words and runs of words that
begin very many suffixes. (Two words of one number would be found here; then another digest is taken.)

The second pass gives, for each place, the suffix of up to ``max_n`` words that starts there. Equal suffixes of a slice are
counted before the shuffle. Suffixes are shuffled by language and first word, into buckets of a bounded expected size;
those of a crowded first word are split further by their second word, those of a crowded pair by their third word, and so
on. A bucket sorts its suffixes in reverse lexicographic order and counts all prefixes with one stack: a prefix closes
where the next suffix no longer shares it, so its count is what came in since it was opened. Prefixes that crowding has
split come from several buckets and are summed. Which ones are crowded comes from a sample, which decides where work
is done, never what is counted.

A phrase's parts are joined afterwards. Scores are whole numbers of up to 38 digits inside.

Texts are lower-cased in A-Z only. Null texts are empty, null languages ``und``. Repeated rows count as often as they occur.
An empty table, or a language without phrases, gives no rows. Ties are in the order of the phrase's UTF-8 bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from silt.llm.common import MIX, batch_of, joined_by_weight, mix64, stored

# What ends a piece and what parts words.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Both as one table: ends become a full stop, which no word can hold, and tabs blanks.
PLAIN = bytes.maketrans(ENDS + BLANKS, b"." * len(ENDS) + b" " * len(BLANKS))

SLICE = 4 << 20  # bytes of text that are counted before a shuffle
CROWD = 1 << 20  # suffixes, about, that a bucket may hold
PARTS = 64  # of a language's phrases, ranked on their own before all are
SAMPLED = 256  # of so many places one is sampled


def words_of(raw: bytes) -> list[bytes]:
    """Lower-case words, with a full stop wherever a piece ends."""
    return raw.lower().translate(PLAIN).replace(b".", b" . ").split()


def number(lang: bytes, words: list[bytes], seed: int) -> np.ndarray:
    """64-bit numbers of words, never 0."""
    start = len(lang).to_bytes(4, "little") + lang
    return np.maximum(np.array([xxhash.xxh3_64_intdigest(start + w, seed) for w in words], np.uint64), np.uint64(1))


def sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(language, texts as one) of batches (lang, text), up to about ``SLICE`` bytes at once; a very long text is one slice."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                held.setdefault(lang, []).append(raw)
                size += len(raw)
                if size >= SLICE:
                    yield from ((k, b"\n".join(v)) for k, v in held.items())
                    held, size = {}, 0
    yield from ((k, b"\n".join(v)) for k, v in held.items())


def coded(words: list[bytes], lang: bytes, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers in ascending order, each word's place among them from 1); 0 where a piece ends."""
    distinct = [w for w in dict.fromkeys(words) if w != b"."]
    numbers = number(lang, distinct, seed)
    order = np.argsort(numbers)
    place = np.empty(len(distinct), np.int64)
    place[order] = np.arange(1, len(distinct) + 1)
    of = dict(zip(distinct, place.tolist(), strict=True)) | {b".": 0}
    return numbers[order], np.fromiter(map(of.__getitem__, words), np.int32, len(words))


def suffixes(codes: np.ndarray, max_n: int) -> np.ndarray:
    """A row of ``max_n`` codes for each word: itself and what follows in its piece, then zeros."""
    out = np.zeros((max_n, len(codes)), np.int32)
    open_ = np.ones(len(codes), bool)
    for k in range(max_n):
        out[k, : len(codes) - k] = codes[k:]
        open_ &= out[k] > 0
        out[k][~open_] = 0
    return out[:, codes > 0]


def ordered(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, shared): the reverse lexicographic order of the columns of a matrix, and how many leading values each shares with the next one."""
    order = np.lexsort(columns[::-1])[::-1]
    same = np.ones(max(len(order) - 1, 0), bool)
    shared = np.zeros(len(order), np.int64)
    for row in columns:
        s = row[order]
        same &= s[1:] == s[:-1]
        shared[:-1] += same
    return order, shared


def prefixes(columns: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, a suffix of each, count) of all prefixes of the suffixes, which occur so many ``times``.

    The stack of the method, one depth at a time: going down the reverse order, the open prefix of a depth is closed by a
    suffix whose successor shares less, and has counted what came in since the one before it was closed.
    """
    order, shared = ordered(columns)
    seen = np.cumsum(times[order])
    for m, row in enumerate(columns, 1):
        closed = np.flatnonzero(shared < m)
        count = np.diff(seen[closed], prepend=0)
        real = row[order[closed]] != 0
        yield m, order[closed[real]], count[real]


class Crowds:
    """Runs of words that begin very many suffixes, by a hash of the run, with the number of buckets that each is split into."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.levels = levels  # ascending hashes and parts, for runs of 1, 2, ... words

    @staticmethod
    def hashed(columns: np.ndarray) -> np.ndarray:
        h = np.zeros(columns.shape[1], np.uint64)
        for row in columns:
            h = mix64(h * MIX + row)
        return h

    def parts(self, columns: np.ndarray) -> np.ndarray:
        """Into how many buckets each run is split; 0 if it is not crowded."""
        keys, parts = self.levels[len(columns) - 1] if len(columns) <= len(self.levels) else (np.empty(0, np.uint64), None)
        if not len(keys):
            return np.zeros(columns.shape[1], np.int64)
        h = self.hashed(columns)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, parts[at], 0)

    def buckets(self, columns: np.ndarray, n: int) -> np.ndarray:
        """The bucket of each suffix: by its first word, and by one word more for each crowded start."""
        key = self.hashed(columns[:1])
        out = (key % np.uint64(n)).astype(np.int64)
        inside = np.ones(columns.shape[1], bool)
        for m in range(1, len(columns)):
            parts = self.parts(columns[:m])
            inside &= parts > 0
            if not inside.any():
                break
            salt = mix64(columns[m][inside] ^ MIX) % parts[inside].astype(np.uint64)
            out[inside] = (mix64(self.hashed(columns[:m, inside]) + salt) >> np.uint64(1)).astype(np.int64) | (1 << 62)
        return out

    def split(self, columns: np.ndarray) -> np.ndarray:
        """Whether the suffixes that begin with these runs lie in several buckets."""
        out = np.ones(columns.shape[1], bool)
        for m in range(1, len(columns) + 1):
            out &= self.parts(columns[:m]) > 0
        return out


def counted_words(df: DataFrame, max_n: int, seed: int) -> DataFrame:
    """From (lang, text), stored: (lang, w0 .., word, f) of all words (the number is w0), and of sampled runs of up to ``max_n`` - 1 words (word is null)."""
    names = [f"w{k}" for k in range(max_n - 1)]
    kind = StructType([StructField("lang", StringType()), *(StructField(c, LongType()) for c in names), StructField("word", BinaryType()), StructField("f", LongType())])
    schema = to_arrow_schema(kind)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, raw in sliced(batches):
            words = words_of(raw)
            found = Counter(words)
            found.pop(b".", None)
            if not found:
                continue
            numbers = number(lang.encode("utf-8", "surrogatepass"), list(found), seed)
            rest = [pa.array(np.zeros(len(found), np.int64))] * (max_n - 2)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(numbers.view(np.int64)), *rest, pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], schema=schema)
            of = dict(zip(found, range(1, len(found) + 1), strict=True)) | {b".": 0}
            codes = np.fromiter(map(of.__getitem__, words), np.int32, len(words))
            some = suffixes(codes, max_n - 1)[:, xxhash.xxh3_64_intdigest(raw) % SAMPLED :: SAMPLED]
            n = some.shape[1]
            if n:
                ids = np.concatenate([np.zeros(1, np.uint64), numbers]).view(np.int64)[some]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n), *map(pa.array, ids), pa.nulls(n, pa.binary()), pa.array(np.full(n, SAMPLED))], schema=schema)

    return stored(df.mapInArrow(count, kind).groupBy(*kind.names[:-1]).agg(F.sum("f").alias("f")), "words")


def crowds_of(places: DataFrame, max_n: int, crowd: int) -> Crowds:
    """Of the sampled runs, those that begin more than ``crowd`` suffixes."""
    levels = []
    for m in range(1, max_n):
        names = [f"w{k}" for k in range(m)]
        many = places.filter(F.col(names[-1]) != 0).groupBy(*names).agg(F.sum("f").alias("n")).filter(F.col("n") > crowd).toArrow()
        runs = np.array([many[c].to_numpy() for c in names], np.int64).view(np.uint64).reshape(m, -1)
        h = Crowds.hashed(runs)
        order = np.argsort(h)
        levels.append((h[order], (-(-2 * many["n"].to_numpy() // crowd))[order].astype(np.int64)))
    return Crowds(levels)


PACKED = StructType([StructField("lang", StringType()), StructField("bucket", LongType()), StructField("packed", BinaryType())])
GRAMS = StructType([StructField("lang", StringType()), StructField("ids", ArrayType(LongType())), StructField("f", LongType()), StructField("split", BooleanType())])


def grams(df: DataFrame, max_n: int, least: int, seed: int, buckets: int, crowds: Crowds) -> DataFrame:
    """From (lang, text), stored: (lang, ids, f) of all runs of up to ``max_n`` words that occur ``least`` times or more."""
    shared = df.sparkSession.sparkContext.broadcast(crowds)
    packed_schema, grams_schema = to_arrow_schema(PACKED), to_arrow_schema(GRAMS)

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3).compress
        for lang, raw in sliced(batches):
            numbers, codes = coded(words_of(raw), lang.encode("utf-8", "surrogatepass"), seed)
            each = suffixes(codes, max_n)
            if not each.shape[1]:
                continue
            order, alike = ordered(each)  # equal suffixes are counted here
            last = np.flatnonzero(alike < max_n)
            each, times = each[:, order[last]], np.diff(last, prepend=-1).astype(np.uint32)
            columns = np.concatenate([np.zeros(1, np.uint64), numbers])[each]
            bucket = shared.value.buckets(columns, buckets)
            order = np.argsort(bucket, kind="stable")
            bucket, columns, times = bucket[order], columns[:, order], times[order]
            ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket))
            out = [(lang, int(bucket[a]), pack(columns[:, a:b].tobytes() + times[a:b].tobytes())) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            yield batch_of(out, packed_schema)

    def count(key: tuple, table: pa.Table) -> pa.Table:
        lang, unpack = key[0].as_py(), zstandard.ZstdDecompressor().decompress
        columns, times = [], []
        for raw in map(unpack, table["packed"].to_pylist()):
            n = len(raw) // (8 * max_n + 4)
            columns.append(np.frombuffer(raw, np.uint64, n * max_n).reshape(max_n, n))
            times.append(np.frombuffer(raw, np.uint32, n, 8 * max_n * n))
        columns, times = np.concatenate(columns, axis=1), np.concatenate(times).astype(np.int64)
        out = []
        for m, one, f in prefixes(columns, times):
            found = columns[:m, one]
            split = shared.value.split(found)
            on = split | (f >= least)
            ids = pa.ListArray.from_arrays(np.arange(0, m * on.sum() + 1, m, dtype=np.int32), pa.array(np.ascontiguousarray(found[:, on].T).reshape(-1).view(np.int64)))
            out.append(pa.RecordBatch.from_arrays([pa.array([lang] * len(ids), pa.string()), ids, pa.array(f[on]), pa.array(split[on])], schema=grams_schema))
        return pa.Table.from_batches(out, grams_schema)

    found = stored(df.mapInArrow(emit, PACKED).groupBy("lang", "bucket").applyInArrow(count, GRAMS), "counts")
    summed = found.filter("split").groupBy("lang", "ids").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return stored(found.filter("NOT split").select("lang", "ids", "f").unionByName(summed), "grams")


def with_part(cuts: DataFrame, known: DataFrame, part: str, name: str) -> DataFrame:
    """``cuts`` with the count of the run in ``part`` as ``name``; a part of very many phrases meets them in no single task."""
    uses = cuts.groupBy("lang", part).agg(F.count("*").alias("uses_"))
    counts = stored(uses.join(known.select("lang", F.col("ids").alias(part), F.col("f").alias(name)), ["lang", part]), "parts")
    return joined_by_weight(cuts, counts, ["lang", part], "uses_").drop("uses_")


def scored(known: DataFrame, share: int) -> DataFrame:
    """(lang, ids, a, l, r, score) of the candidates in ``known`` that no longer candidate holds most of."""
    longer = known.filter("size(ids) > 1").withColumnRenamed("f", "a")
    cuts = longer.withColumn("k", F.explode(F.expr("sequence(1, size(ids) - 1)"))).withColumns({"left": F.expr("slice(ids, 1, k)"), "right": F.expr("slice(ids, k + 1, size(ids) - k)")})
    cuts = with_part(with_part(cuts, known, "left", "l"), known, "right", "r")
    score = F.expr("CAST((CAST(1000000 AS decimal(7,0)) * CAST(a AS decimal(19,0))) * CAST(a AS decimal(19,0)) div (CAST(l AS decimal(19,0)) * CAST(r AS decimal(19,0))) AS bigint)")
    best = cuts.withColumn("score", score).groupBy("lang", "ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = longer.filter("size(ids) > 2").select("lang", "a", F.explode(F.expr("flatten(transform(sequence(2, size(ids) - 1), m -> transform(sequence(1, size(ids) - m + 1), i -> slice(ids, i, m))))")).alias("ids"))
    held = inner.groupBy("lang", "ids").agg(F.max("a").alias("most"))
    kept = best.join(held, ["lang", "ids"], "left").filter(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a")))
    return kept.select("lang", "ids", "a", "cut.l", "cut.r", "cut.score")


def collocations(df: DataFrame, text_col: str, lang_col: str, max_n: int = 3, least: int = 10, top: int = 2000, share: int = 50, crowd: int = CROWD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to ``max_n`` words of each language.

    A candidate occurs ``least`` times; it goes if a longer one that holds it occurs at least ``share`` % as often.
    """
    rows = df.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    for seed in range(8):
        counted = counted_words(rows, max_n, seed)
        words = counted.filter("word IS NOT NULL").select("lang", F.col("w0").alias("id"), "word", "f")
        if words.groupBy("id").count().filter("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("two words share a number under every digest")
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    crowd = max(crowd, total >> 20)  # so there are at most 2**20 crowded runs of a length
    crowds = crowds_of(counted.filter("word IS NULL"), max_n, crowd)
    found = stored(scored(grams(rows, max_n, least, seed, max(8, 2 * total // crowd), crowds), share), "phrases")

    order = [F.desc("score"), F.desc("a")]
    best = lambda df, *within: df.withColumn("place", F.rank().over(Window.partitionBy("lang", *within).orderBy(*order))).filter(F.col("place") <= top).drop("place")
    # the best of each part first, so that what meets in a language's task is bounded
    first = stored(best(best(found, F.expr(f"pmod(xxhash64(ids), {PARTS})"))), "first")
    each = first.select("lang", "ids", F.posexplode("ids").alias("pos", "id")).join(words.filter(F.col("f") >= least).select("id", "word"), "id")
    spelt = each.groupBy("lang", "ids").agg(F.sort_array(F.collect_list(F.struct("pos", F.col("word").cast("string").alias("word")))).alias("w")).withColumn("phrase", F.array_join("w.word", " "))
    named = first.join(spelt.select("lang", "ids", "phrase"), ["lang", "ids"])
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
