"""Line dedup against brute force, and the index through insertions and deletions."""

import hashlib
import re

import numpy as np
import pytest

from silt.llm import lines as ln
from silt.llm import queries


def slow(rows):
    """The contract's columns for (id, text) rows."""
    key = lambda line: re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    order = lambda i: (i is None, i or 0)
    held = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        all_ = (text or "").split("\n")
        kept = [x for x in all_ if not (len(ids := held.get(key(x), {i})) > 1 and min(ids, key=order) != i)]
        out.append((i, len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def texts(seed, n):
    rng = np.random.default_rng(seed)
    some = ["A common line of text", "a common line of TEXT ", "\tanother common one\r", "short", "", "zehn Zeichén", "ÄÖÜäöüßßßß", "İstanbul lines", "x" * 5000]
    return [(int(i), "\n".join(str(rng.choice(some)) if rng.random() < 0.4 else f"line number {rng.integers(0, 400)}" for _ in range(rng.integers(0, 12)))) for i in rng.permutation(n)]


SCHEMA = "doc_id long, text string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_cuckoo_filters_hold_and_forget():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 110_000).astype(np.uint64)
    f = ln.Cuckoo()
    f.insert(h)
    f = ln.Cuckoo(f.to_bytes())
    assert f.contains(h).all()
    other = rng.integers(0, 2**63, 100_000).astype(np.uint64)
    assert f.contains(other).mean() < 4e-4
    f.remove(h[:60_000])
    assert f.contains(h[60_000:]).all() and f.contains(h[:60_000]).mean() < 2e-3
    f.remove(h[60_000:])
    assert not f.slots.any() and not f.stash


def test_an_overfull_filter_uses_its_stash():
    h = np.random.default_rng(1).integers(0, 2**63, 100).astype(np.uint64)
    f = ln.Cuckoo(bits=3)
    f.insert(h)
    assert f.stash and f.contains(h).all() and ln.Cuckoo(f.to_bytes()).contains(h).all()
    f.remove(h)
    assert not f.slots.any() and not f.stash


def test_equal_fingerprints_are_counted():
    h = np.array([5, 5 + (1 << 60), 5 + (1 << 61)], np.uint64)  # one fingerprint, one bucket
    f = ln.Cuckoo()
    f.insert(h)
    f.remove(h[:2])
    assert f.contains(h).all()
    f.remove(h[2:])
    assert not f.contains(h).any()


def test_deduplicated(spark):
    rows = texts(2, 60) + [(3, "A common line of text\nand one more"), (None, "A common line of text\nonly without an id"), (None, "only without an id\nline number 7"), (70, None), (71, "")]
    assert rows_of(ln.deduplicated(spark.createDataFrame(rows, SCHEMA), "doc_id", "text")) == sorted(slow(rows), key=str)


def test_text_ids(spark):
    rows = [(f"d{i}", t) for i, t in texts(3, 20)]
    want = {}
    for i, t in rows:
        want[i] = t
    got = ln.applied(spark.createDataFrame(rows, "doc_id string, text string"), "doc_id", "text", ln.index_of(spark.createDataFrame(rows, "doc_id string, text string"), "doc_id", "text"))
    out = {r.doc_id: r for r in got.collect()}
    seen = set()
    for i in sorted(want):
        keys = [k for k in ln.keys_of(want[i])]
        kept = [x for x, k in zip(want[i].split("\n"), keys) if k not in seen or k is None]
        assert out[i].kept_text == "\n".join(kept)
        seen |= {k for k in keys if k}


@pytest.mark.parametrize("batches", [1, 3])
def test_increments_and_deletions_equal_a_fresh_index(spark, monkeypatch, batches):
    monkeypatch.setattr(ln, "FULL", 150)  # so that several shards are made
    rows = texts(4, 90)
    df = spark.createDataFrame(rows, SCHEMA)
    index = ln.index_of(df, "doc_id", "text", batches)
    assert rows_of(ln.applied(df, "doc_id", "text", index, False).drop("kept_text")) == sorted(slow(rows), key=str)
    assert index.bits > 0
    # keys that are there are found, and hardly any others
    keys = ln.counted(index).select("key")
    assert rows_of(ln.lookup(index, keys)) == rows_of(ln.counted(index))
    # taking documents out, the least ones among them, leaves what an index of the others has
    left = [r for r in rows if r[0] % 3]
    small = ln.remove(index, df.select("doc_id").filter("doc_id % 3 = 0"))
    rest = spark.createDataFrame(left, SCHEMA)
    fresh = ln.index_of(rest, "doc_id", "text", 1)
    assert rows_of(ln.counted(small)) == rows_of(ln.counted(fresh))
    assert rows_of(ln.applied(rest, "doc_id", "text", small, False).drop("kept_text")) == sorted(slow(left), key=str)
    held = lambda i: sum(int((f.slots != 0).sum()) + len(f.stash) for f in (ln.Cuckoo(r.filter) for r in i.filters.collect()))
    assert held(small) == held(fresh) == ln.counted(fresh).count() and held(index) == keys.count()
    # and putting them back gives what there was
    gone = [r for r in rows if not r[0] % 3]
    back = ln.insert(small, ln.stored(ln.postings(spark.createDataFrame(gone, SCHEMA), "doc_id", "text"), "postings"))
    assert rows_of(ln.counted(back)) == rows_of(ln.counted(index)) and held(back) == held(index)


def test_op11_on_a_common_line(spark, tmp_path):
    rows = [(i, "the very common line\n" + f"own line number {i}") for i in range(500)]
    spark.createDataFrame([(*r, 1, b"") for r in rows], SCHEMA + ", id int, key binary").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(queries.QUERIES["op11_line_dedup"](spark, str(tmp_path))) == sorted(slow(rows), key=str)
