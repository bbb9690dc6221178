"""Secret scan with corpus-wide ownership frequency.

Base findings are matches of three fixed patterns. Besides them, every other long token of mixed characters is a
candidate. Candidate digests are counted over the corpus by distinct repositories and owners: a value that several
owners hold, or very many repositories even of one owner, is a copied example; another value that looks random is taken
for a live credential. Candidates of the latter kind that no base finding covers become spans of kind ``live``. Base
findings are always kept.

Null and empty texts have no findings. Null owners and repositories count as one unnamed owner or repository.
Repeated rows are scanned and returned separately, but do not add owners. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silt.llm.common import joined_by_weight, map_texts, stored

# The patterns of the base findings and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
ASSIGN_CHARS, ACCESS_CHARS = 8, 16
KINDS = ("assign", "access", "hex", "live")

#: Other candidates: maximal runs of token characters, with a digit and a letter, 20 long at least.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
PLACEHOLDER = re.compile(r"example|sample|dummy|changeme|placeholder|your|xxxx|1234|abcd|0000", re.IGNORECASE)
PLACEHOLDER_SHARE = 128  # such words count where they make up at least one in so many characters: long values hold them by chance

SPAN = pa.struct([("start", pa.int64()), ("order", pa.int32()), ("stop", pa.int64()), ("value", pa.int64()), ("digest", pa.binary()), ("random", pa.bool_())])
SPAN_SQL = "array<struct<start:bigint,order:int,stop:bigint,value:bigint,digest:binary,random:boolean>>"


def random_looking(value: str) -> bool:
    """Mixed characters, over 3 bits of entropy a character, and placeholder words in less than one in ``PLACEHOLDER_SHARE`` of them."""
    n, words = len(value), sum(len(m) for m in PLACEHOLDER.findall(value))
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return entropy > 3 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and words * PLACEHOLDER_SHARE < max(n, 1)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind order, stop, value) of the base findings, by start, then kind."""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def other_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Candidates that overlap no base finding; both lists are ascending and walked once."""
    out, at, covered = [], 0, 0  # covered: the furthest end of the base findings that begin before the token's end
    for m in TOKEN.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            covered = max(covered, base[at][2])
            at += 1
        if covered <= m.start() and random_looking(m[0]):
            out.append((m.start(), 3, m.end(), m[0]))
    return out


def _rows(spans: list[tuple[int, int, int, str]]) -> list[dict]:
    return [{"start": a, "order": k, "stop": b, "value": b - len(v), "digest": hashlib.sha256(v.encode("utf-8", "surrogatepass")).digest()[:16], "random": k == 3 or random_looking(v)} for a, k, b, v in spans]


def candidates(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """Columns ``keep`` with ``base`` and ``other``, the findings and the further candidates of each whole text."""

    def fn(texts: list[str]) -> dict[str, list]:
        base = [base_spans(t) for t in texts]
        return {"base": [_rows(b) for b in base], "other": [_rows(other_spans(t, b)) for t, b in zip(texts, base, strict=True)]}

    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return map_texts(df, keep, text, fn, {"base": pa.list_(SPAN), "other": pa.list_(SPAN)}, f"{kept}, base {SPAN_SQL}, other {SPAN_SQL}")


def ownership(found: DataFrame, owner: str, repo: str) -> DataFrame:
    """(digest, owners, repos, uses) over all rows; counts are partial before the shuffle."""
    each = found.select(F.explode(F.concat("base", "other")).alias("c"), F.coalesce(owner, F.lit("")).alias("o"), F.coalesce(repo, F.lit("")).alias("r"))
    pairs = each.groupBy(F.col("c.digest").alias("digest"), "o", "r").agg(F.count("*").alias("n"))
    by_owner = pairs.groupBy("digest", "o").agg(F.count("*").alias("rs"), F.sum("n").alias("n"))  # a repository has one owner
    return by_owner.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("rs").alias("repos"), F.sum("n").alias("uses"))


NO_SPANS = "CAST(array() AS array<struct<start:bigint,order:int,stop:bigint,value:bigint,live:boolean,copied:boolean>>)"


def scan(df: DataFrame, id_col: str, text_col: str, owner: str, repo: str, example_owners: int = 3, example_repos: int = 8, extra: list[str] | None = None) -> DataFrame:
    """One row per input row: ``id_col``, ``base``, ``spans`` (start, order, stop, value: where the value starts, live, copied), ``n_live``, ``n_example``, ``most_owners``, ``most_repos``.

    A value held by ``example_owners`` owners or more, or by ``example_repos`` repositories or more, is a copied example. The last
    two columns are the most owners and repositories of any value of the row, 0 without one. ``extra`` names columns to carry.
    """
    carried = extra or []
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text_"), F.col(owner).cast("string").alias("owner_"), F.concat_ws("/", F.col(owner).cast("string"), F.col(repo).cast("string")).alias("repo_"), *carried)
    found = stored(candidates(own, ["id", "owner_", "repo_", *carried], "text_").withColumn("rid", F.monotonically_increasing_id()), "secrets")
    # a value that occurs once has one owner and one repository, so only the counts of the others are joined
    counts = stored(ownership(found, "owner_", "repo_").filter("uses > 1"), "owners")
    uses = found.select("rid", F.explode(F.concat("base", "other")).alias("c")).select("rid", "c.*")
    held = joined_by_weight(uses, counts, ["digest"], "uses", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("owners", "repos")})
    judged = held.withColumn("copied", (F.col("owners") >= example_owners) | (F.col("repos") >= example_repos)).withColumn("live", F.expr("random AND NOT copied"))
    shown = F.when(F.expr("order < 3 OR live"), F.struct("start", "order", "stop", "value", "live", "copied"))
    tallies = {"n_live": F.count_if("live"), "n_example": F.count_if("copied"), "most_owners": F.max("owners"), "most_repos": F.max("repos")}
    spans = judged.groupBy("rid").agg(F.array_sort(F.collect_list(shown)).alias("spans"), *[v.alias(k) for k, v in tallies.items()])
    joined = found.join(spans, "rid", "left")
    return joined.select(F.col("id").alias(id_col), *carried, "base", F.coalesce("spans", F.expr(NO_SPANS)).alias("spans"), *[F.coalesce(k, F.lit(0)).alias(k) for k in tallies])


def listed(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    kinds = "array('" + "','".join(KINDS) + "')"
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at({kinds}, s.order + 1), ':', s.start, ':', s.stop)), ',')")


MASK = "[SECRET]"


def masked(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with each run of spans (start, stop) replaced by ``MASK``."""
    out, at, end = [], 0, -1
    for a, b in sorted(spans):
        if a >= end:
            out += [text[at:a], MASK]
        at = end = max(end, b)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, id_col: str, text_col: str, owner: str, repo: str, **options) -> DataFrame:
    """``df`` with the values of all findings masked in its texts, but for copied examples; other texts stay as they are."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row_"), *[F.col(c).alias(f"{k}_") for k, c in (("i", id_col), ("t", text_col), ("o", owner), ("r", repo))])
    found = scan(rows, "i_", "t_", "o_", "r_", extra=["row_"], **options).withColumn("hide", F.expr("filter(spans, s -> NOT s.copied)"))
    kind = rows.schema["row_"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            new = [masked(t, [(s["value"], s["stop"]) for s in found]) if found else t for t, found in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], names=["row_", "new_"])

    done = found.select("row_", F.col(f"row_.`{text_col}`").alias("t_"), "hide").mapInArrow(run, f"row_ {kind}, new_ string")
    return done.select(*[F.col("new_").alias(c) if c == text_col else F.col(f"row_.`{c}`").alias(c) for c in df.columns])
