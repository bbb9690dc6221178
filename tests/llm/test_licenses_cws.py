import hashlib
from collections import Counter

import duckdb
import numpy as np

from silt.llm import cws, licenses

ROWS = [(5, "alpha beta gamma delta " * 5), (4, None), (3, ""), (9, "ß→é one two three four"), (9, "ß→é one two three four"), (7, "x"), (None, "tail text here"), (2, "alpha beta gamma delta " * 5)]


def slow_next(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    return [(a[0], a[1] or "", b[1] or "") for a, b in zip(order, order[1:] + order[:1])]


def test_edited_texts_follow_the_descending_order(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = cws.fingerprints(df.repartition(3), "doc_id", "text").collect()
    want = [(i, len(a), hashlib.sha256(cws.edited(a, b).encode()).hexdigest()) for i, a, b in slow_next(ROWS)]
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter(want)
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints[5] == prints[2] and prints[4] == prints[3] != prints[7]
    assert next(r.near_next for r in got if r.doc_id == 4) == 1.0
    assert cws.fingerprints(df.limit(0), "doc_id", "text").count() == 0


def test_many_rows_over_many_ranges(spark):
    rows = [(int(i), f"text {i} " * (i % 7)) for i in np.random.default_rng(0).permutation(500)]
    got = cws.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), "doc_id", "text").collect()
    want = [(i, hashlib.sha256(cws.edited(a, b).encode()).hexdigest()) for i, a, b in slow_next(rows)]
    assert sorted((r.doc_id, r.edited_sha256) for r in got) == sorted(want)


def test_collision_rate_is_generalised_jaccard():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words, 200, p=p)) for p in rng.dirichlet(np.ones(60), 6)]
    texts += [t + " w1 w2 w3 w4" * 9 for t in texts]
    sig = cws.Sampler(2048)(texts)
    for i in range(len(texts)):
        for j in range(i):
            a, b = Counter(texts[i].split()), Counter(texts[j].split())
            true = sum((a & b).values()) / sum((a | b).values())
            assert abs(float(cws.likeness(sig[i], sig[j])) - true) < 0.05


def test_very_long_texts_sample_alike():
    s = cws.Sampler(16)
    text = " ".join(f"w{i % 230_000}" for i in range(240_000))
    counts = Counter(text.split())
    whole = s([text])[0]
    h = np.array([s.hash[w] for w in counts], np.uint64)
    r, c, b = s.variates(h)
    w = np.fromiter(counts.values(), np.float32)
    t = np.floor(np.log(w)[:, None] / r + b)
    k = (c - r * (t - b) - r).argmin(axis=0)
    assert (whole == s._sign(h[k], t[k, np.arange(16)])).all()


def test_license_digest_ignores_case_copyright_and_spelling(spark):
    mit = licenses.KNOWN["MIT"]
    other = mit.upper().replace("COPYRIGHT (C) 2000 SOMEONE", "Copyright (c) 1999-2020, Ann & Co.\nAll rights reserved.").replace("SUBLICENSE", "sub-licence").replace("\n\n", "\n\t* ")
    rows = [(1, mit, 1), (2, other, 2), (3, mit + " more", 3), (4, None, 4), (5, "", 5), (5, "", 5), (6, licenses.KNOWN["ISC"].replace(" ", "\n"), 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest int")
    got = licenses.match(df, "doc_id", "text").toPandas()
    by = got.drop_duplicates("doc_id").set_index("doc_id").license_id
    assert by[1] == by[2] == "MIT" and by[6] == "ISC" and by[[3, 4, 5]].isna().all() and len(got) == len(rows)
    documents = df.toPandas()
    want = duckdb.sql(licenses.oracle_sql()).df()
    key = ["doc_id", "digest"]
    assert got.sort_values(key).reset_index(drop=True).fillna("").equals(want.sort_values(key).reset_index(drop=True).fillna("")), documents


def test_whole_licenses_are_known(spark):
    whole = {"Apache-2.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "GFDL-1.2", "GFDL-1.3", "CC0-1.0", "Artistic-1.0-Perl", "BSD-3-Clause-Regents"}
    known = licenses.known_licenses(spark).collect()
    assert len({r.digest for r in known}) == len(known) == len(licenses.KNOWN) and whole <= {r.license_id for r in known}
    rows = [(i, " \n" + licenses.KNOWN[k].replace("\n\n", "\n \n\t").swapcase() + "\n\n", k) for i, k in enumerate(sorted(whole))]
    rows += [(100 + i, f"some prose\n{t}", None) for i, (_, t, _) in enumerate(rows)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    assert {r.doc_id: r.license_id for r in licenses.match(df, "doc_id", "text").collect()} == {i: k for i, _, k in rows}
    documents = df.toPandas()
    want = duckdb.sql(licenses.oracle_sql()).df()
    assert dict(zip(want.doc_id, want.license_id.where(want.license_id.notna(), None))) == {i: k for i, _, k in rows}, documents


def test_neighbours_of_ids_beyond_doubles(spark):
    """Ids that differ by one above 2^53, a null among them, and columns with clashing names."""
    base = 2**60
    rows = [(base + i, f"a{i} b{i} c{i} d e f", i) for i in range(60)] + [(None, "null row here now", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int").repartition(3)
    got = {r.doc_id: r for r in cws.fingerprints(df, "doc_id", "text").collect()}
    assert len(got) == 61
    ids = [*range(base + 59, base - 1, -1), None]
    text = {r[0]: r[1] for r in rows}
    for k, i in enumerate(ids):
        want = cws.edited(text[i], text[ids[(k + 1) % len(ids)]])
        assert got[i].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert cws.fingerprints(df.limit(0), "doc_id", "text").count() == 0
