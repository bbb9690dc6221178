from itertools import combinations

import numpy as np
import pytest

from silt.llm import minhash as mh
from silt.llm.common import WordHash


def slow_similarity(a, b):
    x, y = dict(zip(*map(np.ndarray.tolist, a), strict=True)), dict(zip(*map(np.ndarray.tolist, b), strict=True))
    sx, sy = sum(x.values()), sum(y.values())
    total = 0.0
    for i in x.keys() & y.keys():
        total += 1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys())
    return total if sx and sy else 0.0


def corpus(seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = rng.choice(words, rng.integers(3, 150)).tolist()
        texts.append(" ".join(base))
        for _ in range(rng.integers(0, 6)):
            t = list(base)
            for _ in range(rng.integers(0, 4)):
                t[rng.integers(len(t))] = "new"
            texts.append(" ".join(t))
    return texts + ["", None, "", "a b", "a b", "  a\tb "]


def slow_classes(texts):
    known = WordHash()
    sets = [mh.weighted_shingles(t or "", known) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if (texts[i] or "") == (texts[j] or "") or mh.similarity(sets[i], sets[j]) >= 0.8:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(texts))]


def test_similarity_equals_its_definition():
    known = WordHash()
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = (mh.weighted_shingles(" ".join(rng.choice(list("ab"), rng.integers(1, 30))), known) for _ in range(2))
        assert mh.similarity(a, b) == pytest.approx(slow_similarity(a, b))


def test_registers_estimate_the_similarity():
    known = WordHash()
    sets = [mh.weighted_shingles(t or "", known) for t in corpus(1)]
    sig = mh.signatures(sets)
    err = []
    for i, j in combinations(range(len(sets)), 2):
        s = mh.similarity(sets[i], sets[j])
        if s > 0.1:
            err.append((sig[i] == sig[j]).mean() - s)
    assert abs(np.mean(err)) < 0.03 and np.std(err) < 0.08


@pytest.mark.parametrize("seed", [2, 3])
def test_classes_equal_brute_force(spark, seed):
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in enumerate(texts)], "doc_id long, text string, node int, key string")
    got = {r.doc_id: r.class_id for r in mh.near_duplicates(df, "doc_id", "text").collect()}
    assert [got[i] for i in range(len(texts))] == slow_classes(texts)


def test_links_across_components_of_a_bucket_are_found(spark):
    """A chain whose ends are unlike: the star alone could miss its middle links."""
    base = [f"x{i}" for i in range(200)]
    texts = []
    for k in range(12):
        t = list(base)
        for i in range(k):
            t[i * 16] = f"y{i}"
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in mh.near_duplicates(df, "doc_id", "text").collect()}
    assert [got[i] for i in range(12)] == slow_classes(texts)


def test_empty_and_null_rows(spark):
    df = spark.createDataFrame([(None, None), (None, ""), (None, "a b c d e f")], "doc_id long, text string")
    assert mh.near_duplicates(df, "doc_id", "text").count() == 3
    assert mh.near_duplicates(df.limit(0), "doc_id", "text").count() == 0


def test_blocks_link_what_brute_force_links(spark, monkeypatch):
    """All nodes in one bucket with roots of their own, cut into many blocks."""
    monkeypatch.setattr(mh, "BLOCK_BYTES", 8_000)
    known = WordHash()
    texts = sorted({t for t in corpus(5) if t and t.strip()} | {"a b c d e " * 9, "a b c d e " * 8})
    sets = [mh.weighted_shingles(t, known) for t in texts]
    total = sum(h.nbytes for h, _ in sets)
    assert total > 3 * mh.BLOCK_BYTES
    rows = [(1, 0, i, i, h.astype("<u8").tobytes(), c.astype("<u4").tobytes(), total) for i, (h, c) in enumerate(sets)]
    df = spark.createDataFrame(rows, "bkey long, band int, node long, root long, h binary, c binary, bytes long")
    root = list(range(len(texts)))
    for r in mh.cross_links(df, 0.8).collect():
        assert mh.similarity(sets[r.a], sets[r.b]) >= 0.8
        root = [min(root[r.a], root[r.b]) if x in (root[r.a], root[r.b]) else x for x in root]
    assert root == slow_classes(texts)
