"""Quality rules: decision lists learnt by sequential covering, emitted as Spark conditional expressions.

Measures are taken from whole texts. A rule is a conjunction of thresholds on measures; it is grown on two thirds of
the labelled rows by FOIL gain, pruned on the other third, kept if precise enough there, and the rows that it covers
are removed before the next one. The list is an ordered ``CASE WHEN`` that rejects what any rule covers.

Null texts have no words: every count is 0 and the base fails. Without labels of both kinds the list is empty and
only the base rejects. Rows whose label is null or has no document are not learnt from.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silt.llm.common import bounded_sample, map_texts, stored

# Word and symbol classes, window and limits of the base.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
WINDOW, MIN_WORDS, REPEAT_PERCENT = 5, 10, 20

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct")


def repeated_words(codes: np.ndarray, size: int = WINDOW) -> int:
    """Words inside windows of ``size`` words that occur twice or more; exact, by ranks of ever longer runs."""
    n = len(codes) - size + 1
    if n < 2:
        return 0
    rank, base = codes, int(codes.max()) + 1
    length = 1
    while length < size:  # ranks of runs of `length` words become ranks of runs of `length + step` words
        step = min(length, size - length)
        tail = rank if step == length else codes
        wide = int(tail.max()) + 1
        if step != length and step != 1:
            step, tail, wide = 1, codes, base
        m = len(codes) - length - step + 1
        _, rank = np.unique(rank[:m].astype(np.int64) * wide + tail[length : length + m], return_inverse=True)
        length += step
    twice = np.bincount(rank)[rank] > 1
    if not twice.any():
        return 0
    cover = np.zeros(len(codes) + 1, np.int64)
    cover[: len(twice)] += twice
    cover[size : size + len(twice)] -= twice
    return int((np.cumsum(cover)[:-1] > 0).sum())


def measure_text(text: str) -> tuple[int, ...]:
    """The counts of one text, in the order of COUNTS."""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    seen: dict[str, int] = {}
    codes = [seen.setdefault(w, len(seen)) for w in words]
    repeats = repeated_words(np.array(codes, np.int64)) if len(seen) < len(words) else 0
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats, len(lines), len(seen)


def measure(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """Columns ``keep`` and the counts, as longs."""

    def fn(texts: list[str]) -> dict[str, list]:
        return dict(zip(COUNTS, map(list, zip(*map(measure_text, texts), strict=True)), strict=True))

    kept = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    return map_texts(df, keep, text, fn, dict.fromkeys(COUNTS, pa.int64()), kept + ", ".join(f"{c} long" for c in COUNTS))


#: What rules may test, as SQL over the counts.
MEASURES = {
    "n_words": "CAST(n_words AS double)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words")


@dataclass(frozen=True)
class Test:
    measure: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x > self.threshold if self.above else x <= self.threshold

    def column(self) -> Column:
        value = F.expr(MEASURES[self.measure])
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Test, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for test in rule:
        out &= test.holds(x[test.measure])
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int, cuts: int) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < most and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best, gain = None, 1e-9
        for name, values in x.items():
            for t in np.unique(np.quantile(values[inside], np.linspace(0.0, 1.0, cuts), method="lower")):
                for above in (True, False):
                    test = Test(name, above, float(t))
                    got = inside & test.holds(values)
                    p, n = (got & bad).sum(), (got & ~bad).sum()
                    if p and (g := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > gain:
                        best, gain = test, g
        if best is None:
            break
        rule += (best,)
        inside &= best.holds(x[best.measure])
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.95, least: int = 3, most_rules: int = 12, most_tests: int = 4, cuts: int = 33, seed: int = 7) -> list[Rule]:
    """An ordered list of rules that cover bad rows."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    fold = np.random.default_rng(seed).integers(0, 3, len(bad))
    tries = 0
    while len(rules) < most_rules and tries < 3 * most_rules and (left & bad).any():
        tries += 1
        grow, prune = left & (fold > 0), left & (fold == 0)
        if not (grow & bad).any():
            break
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow], most_tests, cuts)
        px, pb = {k: v[prune] for k, v in x.items()}, bad[prune]
        scored = []
        for k in range(len(rule), 0, -1):
            got = _covers(rule[:k], px, len(pb))
            p, n = (got & pb).sum(), (got & ~pb).sum()
            scored.append(((p - n) / (p + n) if p + n else -1.0, -k, p, n))
        if not scored:
            break
        _, k, p, n = max(scored)
        if p >= least and p >= precision * (p + n):
            rules.append(rule[:-k])
        left &= ~_covers(rule[:-k], x, len(bad))  # a rule that isn't precise enough is dropped, and what it covers set aside
    return rules


def fit(measured: DataFrame, labels: DataFrame, id_col: str, label: str = "quality", max_rows: int = 50_000, **options) -> list[Rule]:
    """Rules from labelled rows (label 0: bad). Rows that the base rejects teach nothing; of the others at most ``max_rows`` are used, those of the least id hashes."""
    one = labels.filter(F.col(label).isNotNull()).groupBy(F.col(id_col).alias("key")).agg(F.min(label).alias("label"))
    joined = measured.withColumnRenamed(id_col, "key").join(one, "key").filter(~base_failed())
    rows = bounded_sample(joined, "key", max_rows, joined.count()).select("label", *[F.expr(sql).alias(m) for m, sql in MEASURES.items()]).toPandas()
    x = {m: rows[m].to_numpy(np.float64) for m in MEASURES}
    bad = rows["label"].to_numpy() == 0
    return learn(x, bad, **options) if len(bad) else []


def verdict(rules: list[Rule]) -> Column:
    """true: kept. The first condition that holds decides."""
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        cond = rule[0].column()
        for test in rule[1:]:
            cond = cond & test.column()
        out = out.when(cond, F.lit(False))
    return out.otherwise(F.lit(True))


def kept_rows(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """The rows of ``df`` that the base and the learnt rules keep. Texts are measured once; the measured rows are stored."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row_"), F.col(text_col).alias("text_"))
    measured = stored(measure(rows, ["row_"], "text_"), "measured")
    learnt = fit(measured.select(F.col(f"row_.`{id_col}`").alias(id_col), *COUNTS), labels, id_col, **options)
    return measured.filter(verdict(learnt)).select("row_.*")
