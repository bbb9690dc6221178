"""Document fingerprints by consistent weighted sampling.

Terms are words, weights their counts. For sample k a term has r, c ~ Gamma(2, 1) and b ~ U(0, 1), all functions of
the term's hash and k. With t = floor(ln w / r + b), the sampled pair is the (term, t) of least
ln a = ln c - r (t - b) - r. Two texts agree on a sample with the probability of their generalised Jaccard similarity.

Null and empty texts have no terms: all their samples are 0, which no text with words has, so they are like each other
and unlike all else. Equal texts have equal fingerprints. Texts are worked on whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silt.llm.common import MIX, WordHash, mix64, slices

SAMPLES = 64


class Sampler:
    def __init__(self, samples: int = SAMPLES):
        self.salt = (mix64(np.arange(1, 3 * samples + 1, dtype=np.uint64) * MIX) | np.uint64(1)).reshape(3, samples)
        self.hash = WordHash()

    def variates(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """r, ln c and b of each term and sample; made in blocks that stay in the cache."""
        shape = (len(h), self.salt.shape[1])
        r, ln_c, b = (np.empty(shape, np.float32) for _ in range(3))
        for s in range(0, len(h), 256):
            part = h[s : s + 256, None]
            u = []
            for salt in self.salt:  # each product of the hash, folded and multiplied again, gives two uniform numbers of 24 bits
                x = part * salt[None, :]
                x ^= x >> np.uint64(32)
                x *= MIX
                halves = (x.view(np.uint32) >> np.uint32(8)).view(np.int32).reshape(*x.shape, 2)
                u.append([halves[..., i].astype(np.float32) * np.float32(2.0**-24) + np.float32(2.0**-25) for i in (1, 0)])
            (u0, u1), (u2, u3), (u4, _) = u
            r[s : s + 256] = -np.log(u0 * u1) + np.float32(1e-12)
            ln_c[s : s + 256] = np.log(-np.log(u2 * u3) + np.float32(1e-30))
            b[s : s + 256] = u4
        return r, ln_c, b

    def __call__(self, texts: list[str]) -> np.ndarray:
        """A row of 32-bit samples for each text."""
        out = np.zeros((len(texts), self.salt.shape[1]), np.uint32)
        at: dict[str, int] = {}
        counts: list[Counter] = []
        rows: list[np.ndarray] = []
        number = at.setdefault
        for i, t in enumerate(texts):  # terms that texts share get their variates once; not too many at a time
            c = Counter(t.split())
            counts.append(c)
            rows.append(np.array([number(w, len(at)) for w in c], np.int64))
            if len(at) > 60_000 or i + 1 == len(texts):
                self._sample(counts, rows, at, out[i + 1 - len(counts) : i + 1])
                counts, rows, at = [], [], {}
                number = at.setdefault
        return out

    def _sample(self, counts: list[Counter], rows: list[np.ndarray], at: dict[str, int], out: np.ndarray) -> None:
        if not at:
            return
        h = np.array(list(map(self.hash.__getitem__, at)), np.uint64)
        if len(h) > 200_000:  # one very long text: in blocks of terms, keeping the least so far
            return self._long(counts, at, h, out)
        r, ln_c, b = self.variates(h)
        ln_a1 = ln_c - r * (np.floor(b) - b + 1)  # at weight 1
        cols = np.arange(out.shape[1])
        for i, (c, idx) in enumerate(zip(counts, rows, strict=True)):
            if not c:
                continue
            w = np.array(list(c.values()), np.float32)
            a = ln_a1[idx]
            more = np.flatnonzero(w > 1)
            if len(more):
                rm, bm = r[idx[more]], b[idx[more]]
                t = np.floor(np.log(w[more])[:, None] / rm + bm)
                a[more] = ln_c[idx[more]] - rm * (t - bm + 1)
            k = np.ascontiguousarray(a.T).argmin(axis=1)
            t = np.floor(np.log(w[k]) / r[idx[k], cols] + b[idx[k], cols])
            out[i] = self._sign(h[idx[k]], t)

    def _long(self, counts: list[Counter], at: dict[str, int], h: np.ndarray, out: np.ndarray) -> None:
        if len(counts) > 1:
            for i, c in enumerate(counts):
                self._sample([c], [np.arange(len(c))], {w: j for j, w in enumerate(c)}, out[i : i + 1])
            return
        w = np.fromiter(counts[0].values(), np.float32, len(h))
        best, sign = np.full(out.shape[1], np.inf), np.zeros(out.shape[1], np.uint32)
        for s in range(0, len(h), 50_000):
            r, ln_c, b = self.variates(h[s : s + 50_000])
            t = np.floor(np.log(w[s : s + 50_000])[:, None] / r + b)
            a = ln_c - r * (t - b) - r
            k, cols = a.argmin(axis=0), np.arange(out.shape[1])
            less = a[k, cols] < best
            best = np.where(less, a[k, cols], best)
            sign = np.where(less, self._sign(h[s : s + 50_000][k], t[k, cols]), sign)
        out[0] = sign

    @staticmethod
    def _sign(h: np.ndarray, t: np.ndarray) -> np.ndarray:
        x = mix64(h ^ (t.astype(np.int64).view(np.uint64) * MIX))
        return np.maximum(x >> np.uint64(32), np.uint64(1)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of samples that agree."""
    return (a == b).mean(axis=-1)


def followed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows dealt so that a task can walk them in descending id order: (dest, extra, id, text_), sorted.

    Ids are cut into ranges by quantiles. The first rows of each range also go, marked ``extra``, to the range before
    it (the very first to the last range), where they follow the last row. Only quantiles and the largest id of each
    range reach the driver; both are bounded by the number of ranges. Ids are numbers; null ids come last; ties are
    ordered by text.
    """
    spark = df.sparkSession
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text_"))
    n = 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = own.select(F.percentile_approx("id", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else None
    bounds = np.array(sorted(set(cuts or [])))

    def ranges(ids: pa.Array) -> np.ndarray:
        """How many bounds are above each id; nulls go to the last range, after its ids."""
        x = ids.fill_null(0).to_numpy(zero_copy_only=False)
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), len(bounds), len(bounds) - np.searchsorted(bounds, x, side="right")).astype(np.int32)

    @F.arrow_udf("int")
    def part(ids: pa.Array) -> pa.Array:
        return pa.array(ranges(ids))

    heads = {r[0]: r[1] for r in own.select("id").groupBy(part("id").alias("p")).agg(F.max("id")).collect()}
    filled = sorted(heads)
    before = {p: filled[i - 1] for i, p in enumerate(filled)}

    @F.arrow_udf("array<int>")
    def dests(ids: pa.Array) -> pa.Array:
        rows = zip(ranges(ids).tolist(), ids.to_pylist(), strict=True)
        return pa.array([[2 * p, 2 * before[p] + 1] if x == heads.get(p) else [2 * p] for p, x in rows], pa.list_(pa.int32()))

    dealt = own.withColumn("d", F.explode(dests("id"))).select(F.expr("shiftright(d, 1)").alias("dest"), F.expr("d % 2").alias("extra"), "id", "text_")
    return dealt.repartition("dest").sortWithinPartitions("dest", "extra", F.col("id").desc_nulls_last(), F.col("text_").asc_nulls_first())


def edited(text: str, following: str) -> str:
    """The last third (rounded down) replaced by as many characters of the start of the next text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def fingerprints(df: DataFrame, id_col: str, text_col: str, samples: int = SAMPLES) -> DataFrame:
    """(``id_col``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row per row."""
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        sample = Sampler(samples)
        last = None  # (dest, id, text, signature) of a row that still waits for the next one
        for batch in batches:
            texts = [t or "" for t in batch.column(3).to_pylist()]
            dest, extra, ids = (batch.column(i).to_pylist() for i in range(3))
            for a, b in slices(texts):
                pairs, before, wait = [], last, None  # pairs of (row, next row); rows are numbers, -1 the one that waited
                at = -1 if last is not None else None
                d_at = last[0] if last is not None else None
                for k in range(a, b):
                    if at is not None and d_at == dest[k]:
                        pairs.append((at, k))
                        at = None
                    if not extra[k]:
                        at, d_at = k, dest[k]
                row = lambda k: before if k < 0 else (dest[k], ids[k], texts[k])
                new = [edited(row(x)[2], texts[y]) for x, y in pairs]
                sig = sample(texts[a:b] + new)  # together: they share most of their terms
                wait = before if at == -1 else None if at is None else (dest[at], ids[at], texts[at], sig[at - a])
                last = wait
                if not pairs:
                    continue
                new_sig = sig[b - a :]
                own_sig, next_sig = np.array([before[3] if x < 0 else sig[x - a] for x, _ in pairs]), np.array([sig[y - a] for _, y in pairs])
                cols = [
                    pa.array([row(x)[1] for x, _ in pairs], batch.schema.field(2).type),
                    pa.array([len(row(x)[2]) for x, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new]),
                    pa.array([s.astype(">u4").tobytes().hex() for s in own_sig]),
                    pa.array([s.astype(">u4").tobytes().hex() for s in new_sig]),
                    pa.array(likeness(own_sig, new_sig), pa.float64()),
                    pa.array(likeness(own_sig, next_sig), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return followed(df, id_col, text_col).mapInArrow(run, schema)
