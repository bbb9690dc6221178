import hashlib
from collections import Counter

import numpy as np
import pytest

from silt.llm import common, suffix


def slow(texts, size=400):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + size] for b in raw for i in range(len(b) - size + 1))
    out = []
    for b in raw:
        on = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                on[i : i + size] = True
        kept = bytes(x for x, r in zip(b, on, strict=False) if not r)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], on])) != 0)
        out.append((len(b), int(on.sum()), (len(edges) + 1) // 2, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefgé"), rng.integers(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(n) for n in (60, 75, 80, 90, 120, 300, 600)]
    texts = []
    for _ in range(60):
        parts = [prose(rng.integers(1, 150))]
        for _ in range(rng.integers(0, 3)):
            s = shared[rng.integers(len(shared))]
            a = rng.integers(0, 30)
            parts += [s[a : len(s) - rng.integers(0, 30)], prose(rng.integers(0, 60))]
        texts.append("".join(parts))
    edited = [t[:200] + "X" + t[200:700] + "Y" + t[701:] for t in texts[:10]]
    exact = prose(100).encode()[:400].decode(errors="ignore")
    return texts + edited + [texts[3], texts[3], None, "", "short", "z" * 900, "ab" * 300, exact + "1", "2" + exact, texts[5] + texts[5]]


@pytest.mark.parametrize(("seed", "hot"), [(2, False), (1, True)])
def test_equals_brute_force(spark, seed, hot, monkeypatch):
    """Also with every anchor taken for a hot one, so that all cores are taken apart into strings."""
    monkeypatch.setattr(suffix, "ROWS", 500)
    monkeypatch.setattr(suffix, "SAMPLED", 50)
    if hot:
        monkeypatch.setattr(suffix, "HOT_LEAST", 1)
        monkeypatch.setattr(common, "HOT", 10**9)
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, node int, suffix string")
    rows = suffix.repeats(df.repartition(3), "doc_id", "text").collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    want, passages = slow(texts), slow(texts, 240)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(w[1] > 0 for w in want) > 20
    by = {r.doc_id: r.n_passage_bytes for r in rows}
    assert [by[i] for i in range(len(texts))] == [p[1] for p in passages] and sum(p[1] > w[1] for p, w in zip(passages, want, strict=True)) > 5
    for size, expected in ((400, want), (240, passages)):
        new = {r.doc_id: r.text for r in suffix.without_repeats(df, "doc_id", "text", size).collect()}
        for i, w in enumerate(expected):
            n = len((new[i] or "").encode())
            assert w[0] - w[1] <= n <= w[0] - w[1] + 4 * w[2]


def test_sorted_strings_meet_across_buckets():
    """Neighbours inside a bucket, first and last ones at its edges, whatever the batches."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    for _ in range(60):
        keys = sorted(bytes([k]) for k in rng.integers(0, 9, rng.integers(1, 25)))
        cuts = sorted(rng.integers(0, len(keys) + 1, 3).tolist())
        out, edges = set(), Counter()
        for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            inner = sorted(rng.integers(a, b + 1, 2).tolist())
            batches = [pa.record_batch({"suffix": pa.array(keys[i:j], pa.binary()), "node": pa.array(range(i, j), pa.int64()), "start": pa.array([0] * (j - i), pa.int32()), "folded": pa.array([False] * (j - i))}) for i, j in zip([a, *inner], [*inner, b], strict=True)]
            for batch in suffix.neighbours(5)(batches):
                for r in batch.to_pylist():
                    if r["edge"] is None:
                        out.add(r["node"])
                    else:
                        edges.setdefault(r["edge"], set())
                        edges[r["edge"]] |= {r["node"]}
        out |= {n for at in edges.values() if len(at) > 1 for n in at}
        assert out == {i for i, k in enumerate(keys) if keys.count(k) > 1}


def test_long_texts_are_handled_in_parts(monkeypatch):
    rng = np.random.default_rng(0)
    raw = bytes(rng.integers(97, 100, 5000).astype(np.uint8))
    whole = suffix.anchors(raw, 400)
    monkeypatch.setattr(suffix, "PART", 700)
    parts = suffix.anchors(raw, 400)
    spread = lambda a: [(g, p) for g, p, lo, hi in zip(*map(np.ndarray.tolist, a), strict=True) for _ in range(lo, hi + 1)]
    assert spread(whole) == spread(parts)


def test_a_run_at_many_places_of_a_text_joins_once(spark, monkeypatch):
    """A short phrase over and over has equal runs at all its places; the text's own repeats need no join."""
    met = []

    def joined(rows, keys, on, *more):
        out = common.joined_by_weight(rows, keys, on, *more)
        if on == ["digest"]:
            met.append(out.count())
        return out

    monkeypatch.setattr(suffix, "joined_by_weight", joined)
    monkeypatch.setattr(suffix, "HOT_LEAST", 1)
    rng = np.random.default_rng(5)
    prose = lambda n: "".join(rng.choice(list("abcdefghij "), n))
    texts = [prose(300) + "word pair " * (150 + i) + prose(300) for i in range(12)]
    texts += [prose(100) + "alone é " * 200, prose(250) + "once more " * 30 + prose(250), prose(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passage_bytes) for r in suffix.repeats(df.repartition(3), "doc_id", "text").collect()}
    want, passages = slow(texts), slow(texts, 240)
    assert [got[i] for i in range(len(texts))] == [(*w, p[1]) for w, p in zip(want, passages, strict=True)]
    assert len(met) == 2 and sum(met) < 10 * len(texts)  # 3,298 when each place is a row


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix.repeats(df, "doc_id", "text").count() == 0
