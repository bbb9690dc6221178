"""Collocations against brute force: common words, ties, overlaps, crowded starts, other lengths."""

import re
from collections import Counter

import numpy as np
import pytest

from silt.llm import phrases as ph
from silt.llm import queries


def slow(rows, max_n=3, least=10, top=2000, share=50):
    """The contract's rows for (text, lang) rows."""
    count, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        f = count.setdefault(lang, Counter())
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update(tuple(w[i : i + m]) for m in range(1, max_n + 1) for i in range(len(w) - m + 1))
    out = []
    for lang, f in count.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        most = Counter()
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    most[p[i : i + m]] = max(most[p[i : i + m]], a)
        best = []
        for p, a in cand.items():
            if 100 * most[p] >= share * a and p in most:
                continue
            s, _, l, r = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            best.append((-s, -a, " ".join(p).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def words(seed, n, vocabulary=60):
    rng = np.random.default_rng(seed)
    base = [f"w{k}" if k % 3 else f"Wé{k}" for k in range(vocabulary)]
    p = 1 / np.arange(1, vocabulary + 1)
    return " ".join(str(rng.choice(base, p=p / p.sum())) + str(rng.choice(["", ".", ",", "\t", "\r\n", " ?!"], p=[0.8, 0.06, 0.06, 0.04, 0.02, 0.02])) for _ in range(n))


SCHEMA = "text string, lang string"
ROWS = [(words(k, 300), ("en", "de", None)[k % 3]) for k in range(24)] + [(None, "en"), ("", "fr"), ("a a a a a a a a a a a a a a", "fr"), ("...!", None), (" solo ", "es")] + [("of the x y z", "en")] * 40 + [("\x00nul 　wide x", "und")] * 12


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, df.collect()))


def test_collocations(spark):
    assert got(ph.collocations(spark.createDataFrame(ROWS, SCHEMA), "text", "lang")) == slow(ROWS)


@pytest.mark.parametrize("max_n,least,top,share,crowd", [(2, 3, 50, 50, 1 << 20), (4, 5, 30, 80, 1 << 20), (3, 4, 40, 50, 64), (5, 3, 2000, 30, 16)])
def test_other_settings_and_crowded_starts(spark, monkeypatch, max_n, least, top, share, crowd):
    """Small crowds split common words, pairs and longer starts over many buckets; counts stay whole."""
    monkeypatch.setattr(ph, "SAMPLED", 3)
    monkeypatch.setattr(ph, "SLICE", 2000)
    assert got(ph.collocations(spark.createDataFrame(ROWS, SCHEMA), "text", "lang", max_n, least, top, share, crowd)) == slow(ROWS, max_n, least, top, share)


def test_crowded_starts_are_split(spark):
    one = np.array([[7] * 1000, range(1, 1001), [0] * 1000], np.uint64)
    crowds = ph.Crowds([(ph.Crowds.hashed(one[:1, :1]), np.array([16])), (np.empty(0, np.uint64), np.empty(0, np.int64))])
    assert len(set(crowds.buckets(one, 8))) == 16 and crowds.split(one[:1, :1]).all() and not crowds.split(one[:2, :1]).any()
    assert len(set(ph.Crowds([]).buckets(one, 8))) == 1


def test_words_of_one_number_are_told_apart(spark, monkeypatch):
    """Where two words share a number, another digest is taken."""
    real = ph.number

    def clashing(lang, words, seed):
        ids = real(lang, words, seed)
        return np.array([1 if seed == 0 and w in (b"w1", b"w2") else i for w, i in zip(words, ids.tolist())], np.uint64)

    monkeypatch.setattr(ph, "number", clashing)
    assert got(ph.collocations(spark.createDataFrame(ROWS, SCHEMA), "text", "lang")) == slow(ROWS)


def test_prefix_counts():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 3, (500, 3))
    rows[:, 1][rows[:, 0] == 0] = 0
    rows[:, 0] += 1
    rows[:, 2][rows[:, 1] == 0] = 0
    times = rng.integers(1, 4, 500)
    want = Counter()
    for r, t in zip(rows.tolist(), times.tolist()):
        for m in range(1, 4):
            if all(r[:m]):
                want[tuple(r[:m])] += t
    columns = rows.T.astype(np.uint64)
    assert {tuple(columns[:m, i].tolist()): int(c) for m, at, f in ph.prefixes(columns, times) for i, c in zip(at, f)} == want


def test_op13_on_odd_tables(spark, tmp_path):
    rows = [(i, *r, "x", 1) for i, r in enumerate(ROWS)]
    spark.createDataFrame(rows, "doc_id long, " + SCHEMA + ", ids string, f int").write.parquet(f"{tmp_path}/some/documents.parquet")
    assert got(queries.QUERIES["op13_collocations"](spark, f"{tmp_path}/some")) == slow(ROWS)
    spark.createDataFrame([], "doc_id long, " + SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert got(queries.QUERIES["op13_collocations"](spark, f"{tmp_path}/none")) == []


def test_op13_on_a_very_long_text(spark, tmp_path):
    rows = [(words(50, 60_000, 400), "en"), ("w1 w2 w3", "en")]
    spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, " + SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert got(queries.QUERIES["op13_collocations"](spark, str(tmp_path))) == slow(rows)
