"""Toxicity: a sparse logistic model that is held still under swaps of identity terms.

Features are the presence of a text's words and of their leading 4, 5 and 6 letters, hashed. The loss is logistic with
an L1 term, plus ``counterfactual`` times the mean square of how far a labelled text's score moves when its identity
terms are swapped for their counterparts, and when they are swapped for no term at all (or counterparts could all
grow alike); so neutral mentions of a group carry little weight. Training is by accelerated proximal gradient in
numpy, on a bounded sample of labelled rows.

Null and empty texts get the score of a text without features. With no labels of both kinds the score is the share of
toxic labels (0 where there are none). Rows with a null id are scored like any other.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silt.llm.common import bounded_sample, map_texts

WORD = re.compile(r"\w+")
BITS = 20
PREFIXES = (4, 5, 6)
PARTS = ("own", "gone", "added", "bare")

#: Counterparts; each term is swapped for the next of its group, the last for the first.
IDENTITY_GROUPS = (
    ("man", "woman"), ("men", "women"), ("boy", "girl"), ("boys", "girls"), ("he", "she"), ("his", "her"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"), ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"), ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("immigrant", "native"), ("immigrants", "natives"), ("disabled", "abled"), ("old", "young"), ("rich", "poor"),
    ("mann", "frau"), ("männer", "frauen"), ("homme", "femme"), ("hommes", "femmes"), ("hombre", "mujer"), ("hombres", "mujeres"),
)
SWAP = {a: g[(i + 1) % len(g)] for g in IDENTITY_GROUPS for i, a in enumerate(g)}


def feature_ids(word: str) -> tuple[int, ...]:
    names = {word, *(f"{word[:k]}~" for k in PREFIXES if len(word) >= k)}
    return tuple(xxhash.xxh3_64_intdigest(n.encode("utf-8", "surrogatepass")) >> (64 - BITS) for n in names)


class Features(dict):
    """word -> feature ids; forgets all once it holds too many."""

    LIMIT = 150_000

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.LIMIT:
            self.clear()
        f = self[word] = feature_ids(word)
        return f

    def of(self, words: set[str]) -> set[int]:
        return set().union(*map(self.__getitem__, words))


def _words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def _features(known: Features, text: str) -> tuple[bytes, bytes, bytes, bytes]:
    """Ids of the text; those that a swap of its identity terms takes away and adds, and those that go with the terms."""
    words = _words(text)
    own = known.of(words)
    moved: tuple[set[int], ...] = (set(), set(), set())
    if not words.isdisjoint(SWAP):
        other = known.of({SWAP.get(w, w) for w in words})
        moved = own - other, other - own, own - known.of(words.difference(SWAP))
    return tuple(np.array(sorted(s), np.int32).tobytes() for s in (own, *moved))


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[int, float]

    def scorer(self):
        """text -> score; words without weight are skipped after their first lookup."""
        weights, bias = self.weights, self.bias

        class Heavy(Features):
            def __missing__(self, word: str) -> tuple[int, ...]:
                if len(self) >= self.LIMIT:
                    self.clear()
                f = self[word] = tuple(i for i in feature_ids(word) if i in weights)
                return f

        heavy = Heavy()

        def score(text: str) -> float:
            z = bias + sum(weights[i] for i in sorted(heavy.of(_words(text))))
            return 1.0 / (1.0 + np.exp(-min(50.0, max(-50.0, z))))

        return score


class Sparse:
    """Rows of ids with values; products with a vector and with its transpose."""

    def __init__(self, rows: list[np.ndarray], values: list[np.ndarray] | None, width: int):
        self.n, self.width = len(rows), width
        sizes = np.array([len(r) for r in rows], np.int64)
        self.ids = np.concatenate(rows).astype(np.int32) if rows else np.empty(0, np.int32)
        self.values = np.concatenate(values) if values else None
        self.sizes, self.ends = sizes, np.cumsum(sizes)

    def dot(self, w: np.ndarray) -> np.ndarray:
        v = w[self.ids] if self.values is None else self.values * w[self.ids]
        total = np.concatenate([[0.0], np.cumsum(v)])
        return total[self.ends] - total[self.ends - self.sizes]

    def back(self, r: np.ndarray) -> np.ndarray:
        v = np.repeat(r, self.sizes)
        return np.bincount(self.ids, v if self.values is None else v * self.values, self.width)


def train(own: list[np.ndarray], gone: list[np.ndarray], added: list[np.ndarray], bare: list[np.ndarray], toxic: np.ndarray, l1: float = 1e-3, counterfactual: float = 1.0, rounds: int = 200, least_rows: int = 4) -> Model:
    n = len(toxic)
    share = float(toxic.mean()) if n else 0.0
    if share in (0.0, 1.0):
        return Model(50.0 if share else -50.0, {})
    ids, seen = np.unique(np.concatenate([*own, *added]), return_counts=True)
    ids = ids[seen >= least_rows]

    def kept(rows: list[np.ndarray]) -> list[np.ndarray]:
        at = [np.searchsorted(ids, r) for r in rows]
        return [a[(a < len(ids)) & (ids[np.minimum(a, len(ids) - 1)] == r)] if len(ids) else a[:0] for a, r in zip(at, rows, strict=True)]

    k_own, k_gone, k_added, k_bare = kept(own), kept(gone), kept(added), kept(bare)
    x = Sparse(k_own, None, len(ids))
    moves = [m for i in range(n) for m in ((k_gone[i], k_added[i]), (k_bare[i], k_bare[i][:0])) if len(m[0]) or len(m[1])]
    d = Sparse([np.concatenate(m) for m in moves], [np.repeat([-1.0, 1.0], [len(a), len(b)]) for a, b in moves], len(ids))
    bias, w = np.log(share / (1 - share)), np.zeros(len(ids))
    at_w, at_b, t, step = w, bias, 1.0, 1.0
    lam = counterfactual / max(1, d.n)
    # products with the weights are kept beside them, so that a round costs one product and one transposed product
    zx, zd = np.full(n, bias), np.zeros(d.n)
    at_zx, at_zd = zx, zd

    def loss(zx: np.ndarray, zd: np.ndarray) -> float:
        return float(np.mean(np.logaddexp(0, zx) - toxic * zx) + lam * np.sum(zd**2))

    for _ in range(rounds):
        r = (1 / (1 + np.exp(-at_zx)) - toxic) / n
        g, gb = x.back(r) + 2 * lam * d.back(at_zd), r.sum()
        here = loss(at_zx, at_zd)
        while True:  # backtracking
            v = at_w - step * g
            nw, nb = np.sign(v) * np.maximum(np.abs(v) - step * l1, 0), at_b - step * gb
            dw, db = nw - at_w, nb - at_b
            nzx, nzd = x.dot(nw) + nb, d.dot(nw)
            if loss(nzx, nzd) <= here + g @ dw + gb * db + (dw @ dw + db * db) / (2 * step) + 1e-12 or step < 1e-8:
                break
            step /= 2
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        m = (t - 1) / nt
        at_w, at_b, at_zx, at_zd = nw + m * (nw - w), nb + m * (nb - bias), nzx + m * (nzx - zx), nzd + m * (nzd - zd)
        still = np.abs(nw - w).max(initial=0) < 1e-4 and abs(nb - bias) < 1e-4
        w, bias, zx, zd, t, step = nw, nb, nzx, nzd, nt, step * 1.1
        if still:
            break
    return Model(float(bias), {int(i): float(v) for i, v in zip(ids, w, strict=True) if v})


def fit(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label: str, learn_from, max_rows: int = 8_000, **options) -> Model:
    """A model from at most ``max_rows`` labelled rows for which ``learn_from`` holds, those of the least id hashes."""
    one = labels.filter(F.col(label).isNotNull()).groupBy(F.col(id_col).alias("key")).agg(F.max(label).cast("int").alias("label")).filter(learn_from(F.col("key")))
    sample = bounded_sample(one, "key", max_rows, one.count())  # at most max_rows ids, so it may be broadcast
    rows = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text_")).join(F.broadcast(sample), "key")

    kept: dict[str, Features] = {}

    def fn(texts: list[str]) -> dict[str, list]:
        known = kept.setdefault("features", Features())
        return dict(zip(PARTS, map(list, zip(*(_features(known, t) for t in texts), strict=True)), strict=True))

    got = map_texts(rows, ["label"], "text_", fn, dict.fromkeys(PARTS, pa.binary()), "label int" + "".join(f", {c} binary" for c in PARTS)).toPandas()
    parts = [[np.frombuffer(b, np.int32) for b in got[c]] for c in PARTS]
    return train(*parts, got["label"].to_numpy(np.float64), **options)


def score(df: DataFrame, keep: list[str], text_col: str, model: Model) -> DataFrame:
    """Columns ``keep`` and ``score``, 0 to 1."""
    made: dict[str, object] = {}

    def fn(texts: list[str]) -> dict[str, list]:
        run = made.get("score") or made.setdefault("score", model.scorer())
        return {"score": [float(run(t)) for t in texts]}

    kept = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    return map_texts(df, keep, text_col, fn, {"score": pa.float64()}, kept + "score double")
