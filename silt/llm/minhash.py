"""Near-duplicates by ProbMinHash.

A text's shingles (five words each; a shorter text is one shingle) are weighted by their counts. Every shingle is a
Poisson process whose rate is its weight; arrivals carry a random register, and a register keeps its first arrival.
Generation stops early: once all registers of a text are filled, shingles whose next arrival is later than the latest
register drop out. The chance that two texts agree on a register is the probability Jaccard similarity of their weighted
shingles. Registers are banded; texts that share a band are candidates; candidates are verified exactly on the whole
texts, and verified pairs (similarity 0.8 or more) are linked. A class is a connected component.

Equal texts are merged first, so a group of copies is one node however large. In a band's bucket every node is compared
with the least node (a star, not all pairs). Only where a bucket still spans several components are its nodes compared
across components: exactly, inside block tasks of bounded bytes, which give no more links than join components. So no
link between components is lost to the star, and pairs that fail are never rows.

Null texts count as empty. Texts without words have no shingles and no links, but equal texts are one class. Nodes are
texts, so repeated rows fall into one class. The class id is the least id of the class's texts (null if all are null).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from silt.llm.common import MIX, WordHash, components, joined_by_weight, map_texts, mix64, shingle_hashes, stored, unit

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
BLOCK_BYTES = 8_000_000  # of shingles in a block of a bucket


def weighted_shingles(text: str, known: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and their counts."""
    words = np.array(list(map(known.__getitem__, text.split())), np.uint64)
    return np.unique(shingle_hashes(words, SHINGLE), return_counts=True)


def signatures(shingles: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A row of ``REGISTERS`` 32-bit values for each text; zeros without shingles. All texts are worked on at once."""
    m = REGISTERS
    sizes = np.array([len(h) for h, _ in shingles])
    when = np.full(len(shingles) * m, np.inf)
    value = np.zeros(len(shingles) * m, np.uint32)
    if sizes.sum() == 0:
        return value.reshape(-1, m)
    key = np.concatenate([h for h, _ in shingles])
    rate = np.concatenate([c for _, c in shingles]).astype(np.float64)
    row = np.repeat(np.arange(len(shingles)), sizes)
    clock = np.zeros(len(key))
    k = 0
    while len(key):
        k += 1
        x = mix64(key + np.uint64(2 * k * int(MIX) % 2**64))
        clock = clock - np.log(unit(x)) / rate
        if k > 1:
            late = when.reshape(-1, m).max(axis=1)
            on = clock < late[row]  # early termination
            key, rate, row, clock, x = key[on], rate[on], row[on], clock[on], x[on]
        at = row * m + (mix64(x ^ MIX) % np.uint64(m)).astype(np.int64)
        before = when[at]
        np.minimum.at(when, at, clock)
        won = (clock == when[at]) & (clock < before)
        value[at[won]] = np.maximum(key[won] >> np.uint64(32), np.uint64(1)).astype(np.uint32)
    return value.reshape(-1, m)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard: the sum over common shingles of 1 / sum of max(a_j / a_i, b_j / b_i) over all shingles j."""
    (ha, ca), (hb, cb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    both = np.intersect1d(ha, hb, assume_unique=True)
    if not len(both):
        return 0.0
    every = np.union1d(ha, hb)
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, ha)] = ca / ca.sum()
    y[np.searchsorted(every, hb)] = cb / cb.sum()
    i = np.searchsorted(every, both)
    # sum_j max(x_j / x_i, y_j / y_i) = (sum of x_j where x_j / y_j >= x_i / y_i) / x_i + (sum of the other y_j) / y_i
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio, kind="stable")
    sorted_ratio = ratio[order]
    below_y = np.concatenate([[0.0], np.cumsum(y[order])])
    above_x = np.concatenate([np.cumsum(x[order][::-1])[::-1], [0.0]])
    at = np.searchsorted(sorted_ratio, ratio[i], side="left")
    return float((1.0 / (above_x[at] / x[i] + below_y[at] / y[i])).sum())


def sign(df: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """Columns ``keep`` with ``sig``, the registers as little-endian unsigned 32-bit values (null without words)."""
    kept: dict[str, WordHash] = {}

    def fn(texts: list[str]) -> dict[str, list]:
        known = kept.get("hash") or kept.setdefault("hash", WordHash())
        sets = [weighted_shingles(t, known) for t in texts]
        sig = signatures(sets)
        return {"sig": [s.tobytes() if len(h) else None for s, (h, _) in zip(sig, sets, strict=True)]}

    schema = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    return map_texts(df, keep, text_col, fn, {"sig": pa.binary()}, schema + "sig binary")


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Of ``pairs`` (a, b), those whose whole texts (node, text_) are similar enough."""
    left = texts.select(F.col("node").alias("a"), F.col("text_").alias("x"))
    right = texts.select(F.col("node").alias("b"), F.col("text_").alias("y"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            on, last, one = [], None, None
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if x != last:
                    last, one = x, weighted_shingles(x, known)
                on.append(similarity(one, weighted_shingles(y, known)) >= threshold)
            yield batch.select([0, 1]).filter(pa.array(on, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def shingled(texts: DataFrame) -> DataFrame:
    """(node, h, c): distinct shingle hashes and counts, as little-endian 64- and 32-bit values."""
    kept: dict[str, WordHash] = {}

    def fn(part: list[str]) -> dict[str, list]:
        known = kept.get("hash") or kept.setdefault("hash", WordHash())
        sets = [weighted_shingles(t, known) for t in part]
        return {"h": [h.astype("<u8").tobytes() for h, _ in sets], "c": [c.astype("<u4").tobytes() for _, c in sets]}

    return map_texts(texts, ["node"], "text_", fn, {"h": pa.binary(), "c": pa.binary()}, "node long, h binary, c binary")


class Block:
    """Nodes of a bucket with their shingles as numbers; compares one node with many."""

    def __init__(self, hashes: list[np.ndarray], counts: list[np.ndarray]):
        self.hashes, self.counts = hashes, counts
        self.size = np.array([len(h) for h in hashes])
        self.end = np.cumsum(self.size)
        self.total = np.array([c.sum() for c in counts], np.float64)
        self.plain = np.array([c.max() == 1 for c in counts])
        _, self.code = np.unique(np.concatenate(hashes), return_inverse=True)
        self.share = np.concatenate(counts) / np.repeat(self.total, self.size)
        self.mark = np.zeros(self.code.max() + 1)

    def linked(self, i: int, others: np.ndarray, threshold: float) -> np.ndarray:
        """Those of ``others`` (ascending) that are similar enough to i."""
        own = slice(self.end[i] - self.size[i], self.end[i])
        self.mark[self.code[own]] = self.share[own]
        at = np.concatenate([np.arange(self.end[j] - self.size[j], self.end[j]) for j in others])
        starts = np.concatenate([[0], np.cumsum(self.size[others])[:-1]])
        overlap = np.add.reduceat(np.minimum(self.mark[self.code[at]], self.share[at]), starts)  # bounds the similarity
        self.mark[self.code[own]] = 0
        out = []
        for j, s in zip(others[overlap >= threshold - 1e-9], overlap[overlap >= threshold - 1e-9], strict=True):
            if self.plain[i] and self.plain[j]:  # the similarity is then the Jaccard similarity of the sets
                both = round(s * max(self.size[i], self.size[j]))
                near = both / (self.size[i] + self.size[j] - both)
            else:
                near = similarity((self.hashes[i], self.counts[i]), (self.hashes[j], self.counts[j]))
            if near >= threshold:
                out.append(j)
        return np.array(out, np.int64)


def cross_links(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links between nodes of one bucket and different roots, enough to join all roots that any link joins.

    ``rows`` has bkey, band, node, root, h, c, bytes (of h over the bucket). Buckets are cut into blocks by bytes, and
    block pairs are tasks of their own.
    """
    cut = rows.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")).withColumn("own", F.expr("CAST(pmod(xxhash64(node), blocks) AS int)"))
    dealt = cut.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        node, root, own = (table[c].to_numpy().copy() for c in ("node", "root", "own"))
        lo, hi = key[2].as_py(), key[3].as_py()
        a, b = [], []
        if len(np.unique(root)) > 1:
            block = Block([np.frombuffer(x, "<u8") for x in table["h"].to_pylist()], [np.frombuffer(x, "<u4").astype(np.int64) for x in table["c"].to_pylist()])
            roots, sizes = np.unique(root, return_counts=True)
            main = roots[sizes.argmax()]
            for i in np.flatnonzero(root != main):  # a pair of different roots has a node outside the main one
                across = (own != own[i]) if lo != hi else np.ones(len(node), bool)
                others = np.flatnonzero(across & (root != root[i]))
                if len(others):
                    for j in block.linked(i, others, threshold):
                        if root[j] != root[i]:
                            a.append(min(node[i], node[j]))
                            b.append(max(node[i], node[j]))
                            root[root == root[j]] = root[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("bkey", "band", "lo", "hi").applyInArrow(run, "a long, b long")


def joined_roots(roots: DataFrame, more: DataFrame) -> DataFrame:
    """(node, root) after further links: these join whole components, so the graph of this step has their roots as nodes."""
    known = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    linked = more.join(known("a"), "a", "left").join(known("b"), "b", "left")
    ends = stored(linked.select("a", F.coalesce("a_root", "a").alias("x"), "b", F.coalesce("b_root", "b").alias("y")), "root-links")
    joined = components(ends.selectExpr("x AS a", "y AS b"), "minhash").selectExpr("node AS root", "root AS joined")
    new = ends.selectExpr("a AS node", "x AS root").union(ends.selectExpr("b AS node", "y AS root")).distinct().join(roots.select("node"), "node", "left_anti")
    return stored(roots.unionByName(new).join(joined, "root", "left").select("node", F.coalesce("joined", "root").alias("root")), "roots")


def classes(df: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """(key binary, class_id, first_id, copies, root): one row for each distinct text, with its class; key is its MD5.

    ``class_id`` is the least id in the class, ``first_id`` the least id of the text, ``copies`` its rows.
    """
    own = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text_")).withColumn("key", F.unhex(F.md5("text_")))
    signed = sign(own, ["id", "key"], "text_")
    nodes = signed.groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    step = 4 * ROWS
    bands = F.expr(f"transform(sequence(0, {BANDS - 1}), b -> struct(b AS band, xxhash64(b, substring(sig, b * {step} + 1, {step})) AS bkey))")
    banded = nodes.filter("sig IS NOT NULL").select("node", F.inline(bands))
    buckets = stored(banded.groupBy("bkey", "band").agg(F.min("node").alias("least"), F.count("*").alias("n")).filter("n > 1"), "buckets")
    members = stored(joined_by_weight(banded, buckets, ["bkey", "band"], "n"), "members")

    # the texts of all nodes that share a band: one row of each, with its least id; rows that repeat even that go by key
    wanted = members.select("node").distinct().join(nodes.select("node", "key", "first_id"), "node")
    rows = own.join(wanted, (own["key"] == wanted["key"]) & own["id"].eqNullSafe(wanted["first_id"]))
    texts = stored(rows.select("node", "text_").dropDuplicates(["node"]), "texts")

    star = stored(members.filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    links = stored(verify(star, texts, threshold), "links")
    roots = components(links, "minhash")

    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("bkey", "band").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n_")).filter("r0 <> r1").select("bkey", "band", "n_")
    rows = stored(joined_by_weight(rooted, stored(mixed, "mixed"), ["bkey", "band"], "n_").select("bkey", "band", "node", "root"), "mixed-rows")
    if not rows.isEmpty():
        sets = stored(shingled(texts.join(rows.select("node").distinct(), "node", "left_semi")), "shingles")
        size = rows.join(sets.select("node", F.length("h").alias("bytes")), "node").groupBy("bkey", "band").agg(F.sum("bytes").alias("bytes"))
        more = stored(cross_links(rows.join(size, ["bkey", "band"]).join(sets, "node"), threshold).distinct(), "links")
        if not more.isEmpty():
            roots = joined_roots(roots, more)

    rooted = nodes.select("node", "key", "first_id", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = stored(rooted, "classes")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("class_id"))
    return rooted.join(least, "root").select("key", "class_id", "first_id", "copies", "root")


def near_duplicates(df: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """(``id_col``, class_id) for every row of ``df``."""
    found = stored(classes(df, id_col, text_col, threshold).select("key", "class_id", "copies"), "found")
    rows = df.select(id_col, F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("key"))
    return joined_by_weight(rows, found, ["key"], "copies").select(id_col, "class_id")


def one_of_each(df: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with one row of each class: of the least id, then of the least key; of repeated rows, one."""
    found = classes(df, id_col, text_col, threshold)
    chosen = found.groupBy("root").agg(F.min(F.struct("first_id", "key")).alias("m")).select("m.first_id", "m.key")
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("key"))
    kept = rows.join(chosen, (rows["key"] == chosen["key"]) & rows["id"].eqNullSafe(chosen["first_id"])).select("row", "id", rows["key"])
    first = F.row_number().over(Window.partitionBy("key", "id").orderBy(F.lit(0)))
    return kept.withColumn("n", first).filter("n = 1").select("row.*")
