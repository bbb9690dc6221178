"""Masked pseudo-likelihood against direct products over paths, finite differences and other partitionings."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from silt.llm import lm


def some_voc(n=40, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(n)]
    pairs = rng.random((256, 256))
    pairs[32, 32] = 0
    with np.errstate(divide="ignore"):
        return lm.Vocabulary(words, np.sort(rng.integers(1, 500, n + 1))[::-1].copy(), np.log(pairs / pairs.sum(axis=1, keepdims=True)))


def some_net(voc, seed=1, kind=np.float32):
    rng, net = np.random.default_rng(seed), lm.initial(voc)
    return {k: (v + rng.standard_normal(v.shape) * 0.3).astype(kind) for k, v in net.items()}


def paths(voc):
    t = voc.tree
    return [list(zip(t.nodes[:n, i], t.signs[:n, i], strict=True)) for i, n in enumerate(t.length)]


def direct(voc, net, ids, p):
    """ln p of every leaf at position p, one path after the other."""
    x = (net["bias"] + sum(net["emb"][ids[p + o]] * net["place"][j] for j, o in enumerate(lm.OFFSETS))).astype(np.float64)
    h = x / (1 + np.abs(x))
    return np.array([sum(-math.log1p(math.exp(-s * (net["out"][k] @ h + net["out_b"][k]))) for k, s in path) for path in paths(voc)])


def test_the_tree_begins_at_the_frequencies():
    voc = some_voc()
    net = lm.initial(voc)
    p = np.exp(direct(voc, net, np.full(5, voc.blank), 2))
    assert p == pytest.approx(voc.counts / voc.counts.sum(), rel=1e-5)
    assert sum(len(x) for x in paths(voc)) < len(voc.counts) * (np.log2(len(voc.counts)) + 4)


def test_log_probs_equal_products_over_paths_and_sum_to_one(monkeypatch):
    monkeypatch.setattr(lm, "BATCH", 16)
    voc = some_voc()
    net, blank = some_net(voc), voc.blank
    rng = np.random.default_rng(4)
    ids = np.concatenate([[blank] * 2, rng.integers(0, blank, 50), [blank] * 2, rng.integers(0, blank, 9), [blank] * 2]).astype(np.int32)
    got = lm.log_probs(voc, net, ids)
    for p in range(len(ids)):
        if ids[p] == blank:
            assert got[p] == 0
        else:
            every = direct(voc, net, ids, p)
            assert got[p] == pytest.approx(every[min(ids[p], len(voc.words))], abs=1e-4) and np.exp(every).sum() == pytest.approx(1, abs=1e-5)
    assert lm.log_probs(voc, net, np.full(2, blank, np.int32)).tolist() == [0, 0]


def test_gradient_equals_finite_differences(monkeypatch):
    monkeypatch.setattr(lm, "BATCH", 16)
    voc = some_voc(12)
    net = some_net(voc, kind=np.float64)
    rng = np.random.default_rng(5)
    ids = np.concatenate([[voc.blank] * 2, rng.integers(0, voc.blank, 40), [voc.blank] * 2, rng.integers(0, 14, 30), [voc.blank] * 2]).astype(np.int32)
    monkeypatch.setattr(lm, "zeros", lambda v, f=lm.zeros: {k: x.astype(np.float64) for k, x in f(v).items()})
    g = lm.zeros(voc)
    lm.add_gradient(voc, net, ids, g)
    assert g["words"][0] == 70
    for name in ("emb", "place", "bias", "out", "out_b"):
        for at in rng.choice(net[name].size, min(30, net[name].size), replace=False):
            flat = net[name].reshape(-1)
            if name == "emb" and at // lm.DIM == voc.blank:
                continue
            was = flat[at]
            flat[at] = was + 1e-3
            up = lm.log_probs(voc, net, ids).sum()
            flat[at] = was - 1e-3
            down = lm.log_probs(voc, net, ids).sum()
            flat[at] = was
            assert g[name].reshape(-1)[at] == pytest.approx((up - down) / 2e-3, abs=2e-3, rel=2e-3)


def test_spelt_words_have_their_own_probabilities():
    """All strings over a small alphabet that have no leaf sum to what the pairs leave, so the whole sums to 1."""
    table = np.zeros((256, 256))
    for a, row in {32: {97: 0.6, 98: 0.4}, 97: {97: 0.2, 98: 0.3, 32: 0.5}, 98: {97: 0.1, 98: 0.1, 32: 0.8}}.items():
        for b, v in row.items():
            table[a, b] = v
    with np.errstate(divide="ignore"):
        voc = lm.Vocabulary(["a", "ab"], np.array([5, 3, 2]), np.log(table))
    strings = [""]
    total = 0.0
    for _ in range(14):
        strings = [s + c for s in strings for c in "ab"]
        total += sum(math.exp(x - voc.ln_spelt) for s, x in zip(strings, voc.spelt(pa.array(strings)), strict=True) if s not in voc.words)
    assert total == pytest.approx(1, abs=2e-3)
    ids, n, spelt = voc.encode(["a bb ab ba a", "", " \t", " b  a "])
    assert n.tolist() == [5, 0, 0, 2] and ids[[0, 2, 4, 12]].tolist() == [0, 1, 0, 0] and (ids == voc.blank).nonzero()[0].tolist() == [5, 6, 7, 8, 9, 10, 13, 14]
    one = lambda w: math.log(math.prod(table[a, b] for a, b in zip(f" {w} ".encode(), f"{w} ".encode(), strict=False))) - voc.ln_spelt
    assert spelt == pytest.approx([one("bb") + one("ba"), 0, 0, one("b")]) and ids[1] != ids[3] and ids[1] in range(2, voc.blank)


def prose(n=600, seed=3):
    """Two languages of 60 words each, a text in one of them, and rare words of their own."""
    rng = np.random.default_rng(seed)
    word = lambda lang, k: f"{'xq'[lang]}{k}"
    out = []
    for i in range(n):
        lang = i % 2
        w = [word(lang, int(k)) for k in np.minimum(rng.geometric(0.06, 80), 60)]
        w[rng.integers(80)] = f"rare{i}"
        out.append(" ".join(w))
    return out


def test_scores_do_not_depend_on_partitions_and_beat_the_unigram(spark, monkeypatch):
    monkeypatch.setattr(lm, "LEAST", 120)
    monkeypatch.setattr(lm, "n_leaves", lambda words: 120)
    monkeypatch.setattr(lm, "FAN", 2)
    monkeypatch.setattr(lm, "SLICE", 1000)
    rows = list(enumerate(prose()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    voc = lm.vocabulary(lm.word_counts(df, "text"))
    encoded = lm.encoded(df.repartition(2), "doc_id", "text", voc)
    trained = lm.train(encoded, voc)
    few = {r.doc_id: r for r in lm.score(encoded, "doc_id", voc, trained).collect()}
    many = {r.doc_id: r for r in lm.pseudo_likelihood(df.repartition(16), "doc_id", "text").collect()}
    assert all(few[i].log_prob == pytest.approx(many[i].log_prob, rel=3e-4) and few[i].n_words == 80 for i in few)
    counts = Counter(w for _, t in rows for w in t.split())
    assert set(voc.words) <= set(counts) and all(voc.counts[i] == counts[w] for i, w in enumerate(voc.words)) and voc.counts.sum() == sum(counts.values())
    net = lm.initial(voc)
    plain = []
    for _, t in rows:
        ids, n, spelt = voc.encode([t])
        plain.append((lm.log_probs(voc, net, np.concatenate([ids[-2:], ids])).sum() + spelt[0]) / n[0])
    gain = np.mean([few[i].mean_log_prob for i in few]) - np.mean(plain)
    assert gain > 0.4  # knowing the language is worth 0.69
    rng = np.random.default_rng(1)
    mixed = [(i, " ".join(rng.permutation((rows[2 * i][1] + " " + rows[2 * i + 1][1]).split())[:80])) for i in range(100)]
    both = spark.createDataFrame(mixed, "doc_id long, text string")
    enc = lm.encoded(both, "doc_id", "text", voc)
    assert np.mean([r.mean_log_prob for r in lm.score(enc, "doc_id", voc, trained).collect()]) < np.mean([few[i].mean_log_prob for i in few]) - 0.5


def test_odd_rows(spark):
    long = " ".join(["one two three"] * 200_000)
    rows = [(1, None, 0), (2, "", 1), (3, " \n ", 2), (4, "one two new", 3), (4, "one two new", 3), (None, "one two", 4), (5, long, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = {}
    for r in lm.pseudo_likelihood(df, "doc_id", "text").collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [tuple(got[i][0]) for i in (1, 2, 3)] == [(i, 0, 0.0, 0.0) for i in (1, 2, 3)]
    assert len(got[4]) == 2 and got[4][0] == got[4][1] and got[4][0].n_words == 3 and got[4][0].log_prob < 0
    assert got[None][0].n_words == 2 and got[5][0].n_words == 600_000 and got[5][0].mean_log_prob == pytest.approx(got[5][0].log_prob / 600_000)


def test_an_empty_table_and_one_without_words(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert lm.pseudo_likelihood(df.limit(0), "doc_id", "text").count() == 0
    assert [tuple(r) for r in lm.pseudo_likelihood(df, "doc_id", "text").orderBy("doc_id").collect()] == [(1, 0, 0.0, 0.0), (2, 0, 0.0, 0.0)]


def test_leaves_follow_the_corpus():
    assert [lm.n_leaves(n) for n in (0, 10**6, 10**8, 10**12)] == [1024, 4000, 40000, 1 << 16]
