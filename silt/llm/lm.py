"""Language-model scoring by masked pseudo-likelihood.

A small window network in numpy predicts every word from the words on both of its sides: each neighbour's vector is
scaled by a vector of its position, the sum goes through x / (1 + |x|), and the word is reached by binary decisions on a path of a
Huffman tree, each a logistic unit. A document's score is the sum over its words of the log-probability of each word
given its neighbours.

All of it follows the whole corpus. The words of all texts are counted into a table of the shared folder. The most
frequent words are leaves of the tree; their number grows with the square root of the corpus count. All other words
are reached by one more leaf and then spelt byte by byte by a table of byte pairs counted over all such words, so each
has a probability of its own; that of the words which have leaves is taken out. Probabilities so sum to 1 over all
strings. As neighbours, words without a leaf have one of ``SHARED`` vectors by hash.

Training is by synchronous rounds: every document belongs to one round by the hash of its id, every word of a round's
documents is a target, tasks sum gradients over their words, the sums are added in slices, and the driver takes one step
a round. So the model depends on the corpus and not on its partitions (but for the order of floating-point sums), and every word of the
corpus trains it. The tree's biases begin at the corpus's frequencies: the network begins as the unigram model.

Null and empty texts have no words: score 0, and a mean of 0. Edges of texts are padded with a blank. Repeated rows are
scored alike. An empty table trains nothing and gives no rows. Very long texts are encoded whole and scored in windows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silt.llm.common import discard, map_texts, mix64, stored

#: Leaves are at most ``MOST`` words, so that what is broadcast (words, paths, network) stays under 32 MB.
LEAST, MOST, SHARED = 1024, 1 << 16, 1024
SIDE, DIM = 2, 12
OFFSETS = [k for k in range(-SIDE, SIDE + 1) if k]
ROUNDS, RATE, DAMP = 12, 0.3, 32.0
BATCH = 16384
SLICE = 1 << 18  # numbers in a slice of the gradient
FAN = 32
BINS = 32  # of counts, to a doubling


def n_leaves(words: int) -> int:
    """Words with leaves for a corpus of so many words."""
    return min(MOST, max(LEAST, 4 * math.isqrt(words)))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, parted by white space, and the number of the text of each."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    some = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(some), parent.filter(some).to_numpy()


def spelling(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The byte pairs (first * 256 + second) that spell the words, blanks at both ends, and where each word's begin."""
    n = len(words)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1] if n else np.zeros(1, np.int32)
    lengths = np.diff(ends)
    s = np.full(int(lengths.sum()) + n + 1, 32, np.uint16)
    if len(s) > n + 1:
        s[np.arange(len(s) - n - 1) + np.repeat(np.arange(1, n + 1), lengths)] = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return s[:-1] * np.uint16(256) + s[1:], np.cumsum(lengths + 1) - lengths - 1


POWERS = mix64(np.arange(1, 1025, dtype=np.uint64))


def shared_slots(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which of the shared vectors each spelt word has."""
    place = np.arange(len(codes)) - np.repeat(first, np.diff(first, append=len(codes)))
    h = np.add.reduceat(codes * POWERS[place % len(POWERS)], first)
    return (mix64(h) % np.uint64(SHARED)).astype(np.int32)


class Tree(NamedTuple):
    """A Huffman tree: nodes and signs of the paths to all leaves, a row a level; how long each is; the order of leaves from left to right; biases that give the counts."""

    nodes: np.ndarray
    signs: np.ndarray
    length: np.ndarray
    rank: np.ndarray
    bias: np.ndarray


@dataclass(frozen=True)
class Vocabulary:
    """Words with leaves by descending count, all counts (the last one is of all other words), and ln p of byte pairs inside those."""

    words: list[str]
    counts: np.ndarray
    pairs: np.ndarray  # 256 x 256; a blank stands for both ends of a word

    @property
    def blank(self) -> int:
        return len(self.words) + SHARED

    @cached_property
    def leaves(self) -> pa.Array:
        return pa.array(self.words, pa.string())

    @cached_property
    def tree(self) -> Tree:
        n = len(self.counts)
        weight = [*np.maximum(self.counts, 1).tolist(), *[0] * (n - 1)]
        heap = [(w, i) for i, w in enumerate(weight[:n])]
        heapq.heapify(heap)
        up, sign = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.float32)
        bias = np.zeros(max(n - 1, 1), np.float32)
        below: list[tuple[int, int]] = []
        for node in range(n, 2 * n - 1):
            (wa, a), (wb, b) = heapq.heappop(heap), heapq.heappop(heap)
            up[a] = up[b] = node
            sign[a], sign[b] = 1.0, -1.0
            bias[node - n] = math.log(wa / wb)
            below.append((a, b))
            heapq.heappush(heap, (wa + wb, node))
        depth, rank, todo = np.zeros(2 * n - 1, np.int32), np.zeros(n, np.int32), [2 * n - 2]
        seen = 0
        while todo:  # leaves from left to right
            at = todo.pop()
            if at < n:
                rank[at], seen = seen, seen + 1
            else:
                depth[list(below[at - n])] = depth[at] + 1
                todo += below[at - n]
        nodes, signs = np.zeros((int(depth.max()), n), np.int32), np.zeros((int(depth.max()), n), np.float32)
        leaf = at = np.arange(n)
        while len(leaf := leaf[depth[at] > 0]):
            at = at[depth[at] > 0]
            nodes[depth[at] - 1, leaf], signs[depth[at] - 1, leaf] = up[at] - n, sign[at]
            at = up[at]
        return Tree(nodes, signs, depth[:n].copy(), rank, bias)

    @cached_property
    def ln_spelt(self) -> float:
        """ln of the share of spelt strings that have no leaf."""
        return math.log1p(-min(math.fsum(np.exp(self.spelt(self.leaves))), 1 - 1e-9))

    def spelt(self, words: pa.Array) -> np.ndarray:
        """ln p of the spelling of each word."""
        if not len(words):
            return np.zeros(0)
        codes, first = spelling(words)
        return np.add.reduceat(self.pairs.reshape(-1)[codes], first)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words of all texts, ``SIDE`` blanks behind each text; the words of each; the sums of ln p(word | no leaf) of those without a leaf."""
        words, parent = words_of(pa.array(texts, pa.string()))
        ids = pc.fill_null(pc.index_in(words, value_set=self.leaves), -1).to_numpy(zero_copy_only=False).copy()
        rare = np.flatnonzero(ids < 0)
        codes, first = spelling(words.take(pa.array(rare)))
        ln = np.zeros(0)
        if len(rare):
            ids[rare] = len(self.words) + shared_slots(codes, first)
            ln = np.add.reduceat(self.pairs.reshape(-1)[codes], first) - self.ln_spelt
        out = np.full(len(words) + SIDE * len(texts), self.blank, np.int32)
        out[np.arange(len(words)) + SIDE * parent] = ids
        return out, np.bincount(parent, minlength=len(texts)), np.bincount(parent[rare], ln, len(texts))


Net = dict[str, np.ndarray]


def initial(voc: Vocabulary, seed: int = 11) -> Net:
    rng = np.random.default_rng(seed)
    f = lambda *s: rng.standard_normal(s).astype(np.float32)
    bias = voc.tree.bias
    net = {"emb": f(voc.blank + 1, DIM) * 0.5, "place": 1 + f(len(OFFSETS), DIM) * 0.3, "bias": np.zeros(DIM, np.float32), "out": np.zeros((len(bias), DIM), np.float32), "out_b": bias.copy()}
    net["emb"][voc.blank] = 0
    return net


def hidden(net: Net, ids: np.ndarray, s: int, e: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words at s to e: which of these are no blanks, their hidden values, and the vectors from s - SIDE to e + SIDE."""
    near = net["emb"][ids[s - SIDE : e + SIDE]]
    kept = np.flatnonzero(ids[s:e] != len(net["emb"]) - 1)
    h = near[: e - s] * net["place"][0]
    part = np.empty_like(h)
    for j, k in enumerate(OFFSETS[1:], 1):
        h += np.multiply(near[SIDE + k : SIDE + k + e - s], net["place"][j], out=part)
    h += net["bias"]
    h /= np.abs(h, out=part) + 1
    return kept, h[kept], near


def levels(voc: Vocabulary, leaf: np.ndarray) -> Iterator[tuple[np.ndarray | slice, np.ndarray, np.ndarray]]:
    """Level by level from the root: which of the leaves (ascending in rank) have a step there, its node, and its sign. Equal nodes are neighbours."""
    n = voc.tree.length[leaf]
    short, deepest = int(n.min()), int(n.max())
    for k in range(deepest):
        on = slice(None) if k < short else np.flatnonzero(n > k)
        at = leaf[on]
        yield on, voc.tree.nodes[k][at], voc.tree.signs[k][at]


def windows(ids: np.ndarray) -> Iterator[tuple[int, int]]:
    return ((s, min(s + BATCH, len(ids) - SIDE)) for s in range(SIDE, len(ids) - SIDE, BATCH))


def log_probs(voc: Vocabulary, net: Net, ids: np.ndarray) -> np.ndarray:
    """ln p(leaf | both sides) at each position, 0 at blanks; ``ids`` begin and end with ``SIDE`` blanks."""
    out = np.zeros(len(ids))
    if len(voc.counts) < 2:
        return out
    for s, e in windows(ids):
        kept, h, _ = hidden(net, ids, s, e)
        if len(kept):
            leaf = np.minimum(ids[s:e][kept], len(voc.words))
            order = np.argsort(voc.tree.rank[leaf])
            h, lp = h[order], np.zeros(len(kept), h.dtype)
            for on, node, sign in levels(voc, leaf[order]):
                z = (np.einsum("ij,ij->i", net["out"][node], h[on]) + net["out_b"][node]) * sign
                lp[on] -= np.log(1 + np.exp(-np.maximum(z, -80)))
            out[s + kept[order]] = lp
    return out


def starts(key: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.empty(len(key), bool)
    new[0] = True
    np.not_equal(key[1:], key[:-1], out=new[1:])
    return np.flatnonzero(new)


def zeros(voc: Vocabulary) -> Net:
    """An empty gradient: that of the network, and how often each node and each vector took part."""
    n, m = voc.blank + 1, len(voc.tree.bias)
    shapes = {"emb": (n, DIM), "place": (len(OFFSETS), DIM), "bias": (DIM,), "out": (m, DIM), "out_b": (m,), "emb_n": (n,), "out_n": (m,), "words": (1,)}
    return {k: np.zeros(s, np.float32) for k, s in shapes.items()}


def add_gradient(voc: Vocabulary, net: Net, ids: np.ndarray, into: Net) -> None:
    """Add the gradient of the summed log-probabilities of all words of ``ids``."""
    if len(voc.counts) < 2:
        return
    for s, e in windows(ids):
        kept, h, near = hidden(net, ids, s, e)
        if not len(kept):
            continue
        leaf = np.minimum(ids[s:e][kept], len(voc.words))
        order = np.argsort(voc.tree.rank[leaf])
        hs, ds, buffer = h[order], np.zeros_like(h), np.empty_like(h)
        for on, node, sign in levels(voc, leaf[order]):
            w, x = net["out"][node], hs[on]
            z = (np.einsum("ij,ij->i", w, x) + net["out_b"][node]) * sign
            g = sign / (1 + np.exp(np.clip(z, -80, 80)))
            start = starts(node)
            at = node[start]
            into["out"][at] += np.add.reduceat(np.multiply(x, g[:, None], out=buffer[: len(g)]), start, axis=0)
            into["out_b"][at] += np.add.reduceat(g, start)
            into["out_n"][at] += np.diff(start, append=len(node))
            w *= g[:, None]
            ds[on] += w
        dh = np.empty_like(ds)
        dh[order] = ds
        dh *= np.square(1 - np.abs(h))
        wide = np.zeros((e - s, DIM), np.float32)
        wide[kept] = dh
        grad, seen = np.zeros_like(near), np.zeros(len(near), near.dtype)
        for j, k in enumerate(OFFSETS):
            part = slice(SIDE + k, SIDE + k + e - s)
            grad[part] += wide * net["place"][j]
            seen[part] += 1
            into["place"][j] += np.einsum("ij,ij->j", wide, near[part])
        key = ids[s - SIDE : e + SIDE]
        order = np.argsort(key)
        start = starts(key[order])
        at = key[order[start]]
        into["emb"][at] += np.add.reduceat(grad[order], start, axis=0)
        into["emb_n"][at] += np.add.reduceat(seen[order], start)
        into["bias"] += dh.sum(axis=0)
        into["words"] += len(kept)


def ascend(net: Net, g: Net, moved: dict[str, tuple[np.ndarray, np.ndarray]], k: int, rounds: int, rate: float = RATE) -> None:
    """Step k: Adam on the mean gradient of each row, where rows that few words met are damped. The blank stays 0."""
    words = float(g["words"][0])
    if not words:
        return
    mean = {
        "out": g["out"] / (g["out_n"] + DAMP)[:, None], "out_b": g["out_b"] / (g["out_n"] + DAMP),
        "emb": 4 * g["emb"] / (g["emb_n"] + DAMP)[:, None], "place": g["place"] / words, "bias": g["bias"] / words,
    }
    mean["emb"][-1] = 0
    rate *= 1 - 0.7 * k / rounds
    for name, v in mean.items():
        m, s = moved.get(name, (0.0, 0.0))
        m, s = moved[name] = 0.5 * m + 0.5 * v, 0.9 * s + 0.1 * v * v
        net[name] = (net[name] + rate * (m / (1 - 0.5 ** (k + 1))) / (np.sqrt(s / (1 - 0.9 ** (k + 1))) + 0.01)).astype(np.float32)


def word_counts(df: DataFrame, text_col: str) -> DataFrame:
    """(word, n): every word of the corpus and its count, as a table in the shared folder."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []

        def flush() -> pa.RecordBatch:
            seen = pc.value_counts(pa.chunked_array(held, pa.string()))
            held.clear()
            return pa.RecordBatch.from_arrays([seen.field("values"), seen.field("counts")], names=["word", "n"])

        for batch in batches:
            for text in (batch.column(0).slice(i, 256) for i in range(0, batch.num_rows, 256)):
                held.append(words_of(text.cast(pa.string()))[0])
                if sum(map(len, held)) > 6_000_000:
                    yield flush()
        yield flush()

    return stored(df.select(text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The words with leaves, and the byte pairs of all others. The driver gets those words, a histogram of counts, and at most 65,536 sums."""
    bins = F.floor(F.log2("n") * BINS)
    seen = sorted(((r.b, r.k, r.n) for r in counts.groupBy(bins.alias("b")).agg(F.count("*").alias("k"), F.sum("n").alias("n")).collect()), reverse=True)
    all_words = sum(n for _, _, n in seen)
    left = n_leaves(all_words)
    least, share = -1, 1.0  # bins above the least one are taken whole, of that one a share by hash
    for b, k, _ in seen:
        if k > left:
            least, share = b, left / k
            break
        left -= k
    owned = F.col("b") > least if least >= 0 else F.lit(True)
    owned = owned | ((F.col("b") == least) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20))))
    told = counts.withColumn("b", bins)
    own = sorted((-r.n, r.word) for r in told.filter(owned).select("word", "n").collect())

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16)
        for batch in batches:
            codes, first = spelling(batch.column(0).cast(pa.string()))
            total += np.bincount(codes, np.repeat(batch.column(1).to_numpy(), np.diff(first, append=len(codes))), 1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], names=["pair", "n"])

    table = np.ones((256, 256))  # every pair once more than it is seen, so no word is impossible
    table[32, 32] = 0  # words are not empty
    for r in told.filter(~owned).select("word", "n").mapInArrow(pairs, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        table[r.pair // 256, r.pair % 256] += r.n
    with np.errstate(divide="ignore"):
        ln = np.log(table / table.sum(axis=1, keepdims=True))
    own_counts = [-n for n, _ in own]
    return Vocabulary([w for _, w in own], np.array([*own_counts, all_words - sum(own_counts)], np.int64), ln)


def encoded(df: DataFrame, id_col: str, text_col: str, voc: Vocabulary) -> DataFrame:
    """(``id_col``, ids, n_words, spelt, round_) of every row, stored; each round's rows are in a folder of their own."""
    _ = voc.leaves, voc.tree, voc.ln_spelt  # made once, and sent along
    shared = df.sparkSession.sparkContext.broadcast(voc)

    def fn(texts: list[str]) -> dict[str, list | pa.Array]:
        ids, n, spelt = shared.value.encode(texts)
        ends = np.concatenate([[0], 4 * np.cumsum(n + SIDE)]).astype(np.int32)
        return {"ids_": pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(ids)]), "n_words": pa.array(n, pa.int64()), "spelt_": pa.array(spelt, pa.float64())}

    kind = df.schema[id_col].dataType.simpleString()
    out = map_texts(df, [id_col], text_col, fn, {"ids_": pa.binary(), "n_words": pa.int64(), "spelt_": pa.float64()}, f"`{id_col}` {kind}, ids_ binary, n_words long, spelt_ double")
    return stored(out.withColumn("round_", F.pmod(F.xxhash64(F.lit(29), id_col), F.lit(ROUNDS)).cast("int")), "encoded", by="round_")


def _joined(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of rows with about ``BATCH`` ids or more: (first row, next row, all ids with blanks before them, where each row's ids end)."""
    at, ids, n = 0, [], 0
    for i, raw in enumerate(column):
        ids.append(np.frombuffer(raw.as_buffer(), np.int32))
        n += len(ids[-1])
        if n >= 2 * BATCH or i + 1 == len(column):
            ends = SIDE + np.cumsum([len(x) for x in ids])
            yield at, i + 1, np.concatenate([ids[-1][-SIDE:], *ids]), ends
            at, ids, n = i + 1, [], 0


def train(rows: DataFrame, voc: Vocabulary, rounds: int = ROUNDS, rate: float = RATE) -> Net:
    """The network after one step for each round's rows. Slices of the summed gradient, of the size of the network, reach the driver."""
    spark, net, moved, empty = rows.sparkSession, initial(voc), {}, zeros(voc)
    n_slices = -(-sum(v.size for v in empty.values()) // SLICE)
    words = spark.sparkContext.broadcast(voc)

    def sums(model) -> tuple:
        def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            voc, net = words.value, model.value
            into = zeros(voc)
            for batch in batches:
                for _, _, ids, _ in _joined(batch.column(0)):
                    add_gradient(voc, net, ids, into)
            if into["words"][0]:
                flat = np.concatenate([v.ravel() for v in into.values()])
                yield pa.RecordBatch.from_arrays([pa.array(range(n_slices), pa.int32()), pa.array([flat[i * SLICE : (i + 1) * SLICE].tobytes() for i in range(n_slices)], pa.binary())], names=["slice", "sums"])

        def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    total[k] = total.get(k, 0.0) + np.frombuffer(raw.as_buffer(), np.float32).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.astype(np.float32).tobytes() for v in total.values()], pa.binary())], names=["slice", "sums"])

        return local, add

    for k in range(rounds):
        model = spark.sparkContext.broadcast(net)
        local, add = sums(model)
        each = rows.filter(F.col("round_") == k).select("ids_").mapInArrow(local, "slice int, sums binary")
        groups = -(-each.rdd.getNumPartitions() // FAN)
        while groups > 1:  # a task adds up about FAN slices, however many tasks there were
            each = each.repartition(n_slices * groups, "slice", F.pmod(F.spark_partition_id(), F.lit(groups))).mapInArrow(add, "slice int, sums binary")
            groups = -(-groups // FAN)
        got = {r.slice: r.sums for r in each.repartition(n_slices, "slice").mapInArrow(add, "slice int, sums binary").collect()}
        model.destroy()
        if got:
            flat, at, g = np.frombuffer(b"".join(bytes(got[i]) for i in range(n_slices)), np.float32), 0, {}
            for name, v in empty.items():
                g[name] = flat[at : at + v.size].reshape(v.shape)
                at += v.size
            ascend(net, g, moved, k, rounds, rate)
    return net


def score(rows: DataFrame, id_col: str, voc: Vocabulary, net: Net) -> DataFrame:
    """(``id_col``, n_words, log_prob, mean_log_prob) of encoded rows."""
    model = rows.sparkSession.sparkContext.broadcast((voc, net))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, net = model.value
        for batch in batches:
            for a, b, ids, ends in _joined(batch.column(1)):
                part = batch.slice(a, b - a)
                total = np.cumsum(log_probs(voc, net, ids))[ends - 1]
                lp = np.diff(total, prepend=0.0) + part.column(3).to_numpy()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(lp), pa.array(lp / np.maximum(part.column(2).to_numpy(), 1))], names=[id_col, "n_words", "log_prob", "mean_log_prob"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, "ids_", "n_words", "spelt_").mapInArrow(run, f"`{id_col}` {kind}, n_words long, log_prob double, mean_log_prob double")


def pseudo_likelihood(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Train on all words of ``df`` and score each row."""
    counts = word_counts(df, text_col)
    voc = vocabulary(counts)
    discard(counts)
    rows = encoded(df.select(id_col, text_col), id_col, text_col, voc)
    return score(rows, id_col, voc, train(rows, voc))
