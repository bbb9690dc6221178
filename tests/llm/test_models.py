"""The learnt parts against plain versions: the toxicity model against a dense solver, verdicts against rules applied in Python."""

import numpy as np
import pyarrow.parquet as pq

from silt.llm import queries, rules, toxicity

SF = "/root/testdata/sf0.001"


def objective(bias, w, x, d, y, l1, lam):
    z = x @ w + bias
    return np.mean(np.logaddexp(0, z) - y * z) + lam * np.sum((d @ w) ** 2) + l1 * np.abs(w).sum()


def dense(x, d, y, l1, lam, rounds=60_000):
    """Proximal gradient steps of a safe fixed length, without any of the model's shortcuts."""
    n, bias, w = len(y), float(np.log(y.mean() / (1 - y.mean()))), np.zeros(x.shape[1])
    one = np.column_stack([x, np.ones(n)])
    step = 1 / (np.linalg.eigvalsh(one.T @ one / (4 * n)).max() + 2 * lam * np.linalg.eigvalsh(d.T @ d).max(initial=0))
    for _ in range(rounds):
        r = (1 / (1 + np.exp(-(x @ w + bias))) - y) / n
        v = w - step * (x.T @ r + 2 * lam * d.T @ (d @ w))
        bias, w = bias - step * r.sum(), np.sign(v) * np.maximum(np.abs(v) - step * l1, 0)
    return bias, w


def test_the_model_is_the_minimum_that_a_dense_solver_finds():
    rng = np.random.default_rng(4)
    n, words = 200, 30
    x = (rng.random((n, words)) < 0.2).astype(float)
    y = (x[:, 0] + x[:, 1] - x[:, 2] + rng.normal(0, 0.4, n) > 0.4).astype(float)
    x[:, 5] = np.where(rng.random(n) < 0.7, y, x[:, 5])  # an identity term that goes with the label
    ids = lambda m: [np.flatnonzero(r).astype(np.int32) for r in m]
    gone, added, bare = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
    has = x[:, 5] > 0
    gone[has, 5], added[has, 6], bare[has, 5] = 1, 1, 1
    model = toxicity.train(ids(x), ids(gone), ids(added), ids(bare), y, l1=2e-3, counterfactual=1.0, rounds=5000)
    d = np.concatenate([(added - gone)[has], -bare[has]])
    lam = 1.0 / len(d)
    bias, w = dense(x, d, y, 2e-3, lam)
    own = np.array([model.weights.get(i, 0.0) for i in range(words)])
    assert abs(objective(model.bias, own, x, d, y, 2e-3, lam) - objective(bias, w, x, d, y, 2e-3, lam)) < 1e-4
    assert np.abs(1 / (1 + np.exp(-(x @ own + model.bias))) - 1 / (1 + np.exp(-(x @ w + bias)))).max() < 5e-3
    assert abs(own[5]) < 0.3 * abs(toxicity.train(ids(x), ids(0 * x), ids(0 * x), ids(0 * x), y, l1=2e-3, rounds=5000).weights[5])
    short = toxicity.train(ids(x), ids(gone), ids(added), ids(bare), y, l1=2e-3, counterfactual=1.0)
    have = np.array([short.weights.get(i, 0.0) for i in range(words)])
    assert objective(short.bias, have, x, d, y, 2e-3, lam) - objective(bias, w, x, d, y, 2e-3, lam) < 1e-3  # at the production number of rounds


def test_op6_scores_equal_the_model_in_plain_python(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    import zlib

    from pyspark.sql import functions as F

    fold = lambda c: F.crc32(c.cast("string").cast("binary")) % 5
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "text", "toxic", lambda c: fold(c) != 0)
    got = {r.doc_id: r for r in queries.QUERIES["op6_toxicity"](spark, SF).collect()}
    for i, text in zip(docs["doc_id"], docs["text"], strict=True):
        words = set(toxicity.WORD.findall((text or "").lower()))
        features = {f for w in words for f in toxicity.feature_ids(w)}
        z = model.bias + sum(model.weights.get(f, 0.0) for f in features)
        assert abs(got[i].score - 1 / (1 + np.exp(-np.clip(z, -50, 50)))) < 1e-9 and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_op8_verdicts_equal_the_rules_in_plain_python(spark):
    wide = "/root/testdata/sf0.01"  # enough labels for rules
    docs = pq.read_table(f"{wide}/documents.parquet").to_pydict()
    measured = rules.measure(spark.read.parquet(f"{wide}/documents.parquet"), ["doc_id"], "text")
    learnt = rules.fit(measured, spark.read.parquet(f"{wide}/labels.parquet"), "doc_id")
    assert learnt
    got = {r.doc_id: r.kept for r in queries.QUERIES["op8_quality_rules"](spark, wide).collect()}
    for i, text in zip(docs["doc_id"], docs["text"], strict=True):
        n = dict(zip(rules.COUNTS, rules.measure_text(text or ""), strict=True))
        words, lines = max(n["n_words"], 1), max(n["n_lines"], 1)
        value = {"n_words": n["n_words"], "chars_per_word": n["word_chars"] / words, "symbols_per_word": n["n_symbols"] / words, "dup_line_share": n["n_dup_lines"] / lines,
                 "repeat_share": n["n_repeat_words"] / words, "distinct_share": n["n_distinct"] / words, "words_per_line": n["n_words"] / lines}
        kept = not (n["n_words"] < 10 or 100 * n["n_repeat_words"] > 20 * n["n_words"])
        for rule in learnt:
            kept &= not all(value[t.measure] > t.threshold if t.above else value[t.measure] <= t.threshold for t in rule)
        assert got[i] == kept, i
