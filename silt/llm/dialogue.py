"""Conversation structure repair: the cheapest edits that give a legal order of roles, by a dynamic programme over a trie.

Every row of a conversation is one sign: its role's initial and its fault. Rows are kept (K, 0), given the role that is due
(R, 1) or deleted (D, 2; the only way for blank and duplicate rows), empty rows are inserted (I, 5), and a truncated row
that stays adds 5. The roles that are left must read ``(s?(ua)+)?``. Among the cheapest edits those whose letters are least
in ASCII order are taken.

The programme reads signs from left to right. A layer has, for each of four ends (nothing yet, s, u, a), the least cost and
the order of the least letters that lead there; letters of different ends are never prefixes of one another, as all end
in an edit of a row, so the order is all that later comparisons need. Signatures are range-partitioned and sorted, so a
task walks its part of the prefix trie depth first: the layers of the path are kept, those of a common prefix are used
again, and the answer is read off backwards at a terminal node. A signature that very many conversations share is
salted over several ranges.

A conversation is never held as a whole: its rows are sorted by Spark (spilling where they must) and stream through a
task that keeps a letter for each. One conversation is one task's, as one digest over all its text has to see it in order.

Null roles and texts are one space; a role without the initial s, u or a can only be replaced or deleted. Rows are taken by
turn (nulls first), then by role and text, so ties have one order; repeated rows are duplicates. Null ids are one
conversation. A conversation without rows (``present`` is false in all) has zeros, no letters and the digest of the empty
string. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from silt.llm.common import batch_of, stored

# Blanks, ends of sentences, costs, and the pairs of initials that may follow one another.
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LEGAL = {"su", "ua", "au"}

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
DUE = (USER, USER, ASSISTANT, USER)  # the role that may be inserted, or given, at each end
NAMES = {USER: "user", ASSISTANT: "assistant"}
INF = 1 << 30
SALTS = 64


def move(end: int, sign: str) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, new end) of what may be done with a row. ``sign``: D (must go), or a role's initial, upper case where truncated."""
    yield "D", DELETE, end
    if sign == "D":
        return
    extra = TRUNCATED if sign.isupper() else 0
    kept = {"s": SYSTEM if end == NOTHING else None, "u": USER if end != USER else None, "a": ASSISTANT if end == USER else None}.get(sign.lower())
    if kept is not None:
        yield "K", KEEP + extra, kept
    yield "R", REROLE + extra, DUE[end]


def inserts(end: int) -> Iterator[tuple[int, int]]:
    """(number of inserts, new end); more than two only come back."""
    yield 0, end
    for n in (1, 2):
        end = DUE[end]
        yield n, end


#: A layer: for each end its cost above the least one, and its place in the order of letters.
Layer = tuple[tuple[int, ...], tuple[int, ...]]
START: Layer = ((0, INF, INF, INF), (0, 1, 2, 3))


@lru_cache(maxsize=1 << 16)
def step(layer: Layer, sign: str) -> tuple[Layer, int, tuple[tuple[int, str] | None, ...]]:
    """(next layer, what its least cost adds, for each end where it came from and by which letters)."""
    costs, order = layer
    best: list[tuple | None] = [None] * 4
    for end, cost in enumerate(costs):
        if cost >= INF:
            continue
        for n, at in inserts(end):
            for letter, price, to in move(at, sign):
                way = (cost + n * INSERT + price, order[end], "I" * n + letter, end)
                if best[to] is None or way < best[to]:
                    best[to] = way
    least = min(way[0] for way in best if way)
    ranks = {way[1:3]: k for k, way in enumerate(sorted((w for w in best if w), key=lambda w: w[1:3]))}
    ends = tuple(way[0] - least if way else INF for way in best)
    # the order is over reached ends only; ends out of reach have a fixed place, so that equal layers are one
    return (ends, tuple(ranks[way[1:3]] if way else 3 for way in best)), least, tuple((way[3], way[2]) if way else None for way in best)


def finish(layer: Layer) -> tuple[int, int, str]:
    """(cost, end, inserts) of the cheapest legal conclusion."""
    costs, order = layer
    ways = [(costs[end] + n * INSERT, order[end], n, end) for end in range(4) if costs[end] < INF for n, at in inserts(end) if at in (NOTHING, ASSISTANT)]
    cost, _, n, end = min(ways)
    return cost, end, "I" * n


class Walk:
    """A depth-first walk over the trie of sorted signatures: the path's layers, by number, with the cost so far."""

    def __init__(self) -> None:
        self.number: dict[Layer, int] = {START: 0}
        self.layers: list[Layer] = [START]
        self.path, self.costs = array("i", [0]), array("q", [0])
        self.sign, self.made = "", 0

    def answer(self, sign: str) -> tuple[int, str]:
        """(cost, letters) at the node of this signature; layers of the prefix shared with the last one are taken as they are."""
        common, most = 0, min(len(sign), len(self.sign))
        if sign[:most] == self.sign[:most]:
            common = most
        else:
            while sign[common] == self.sign[common]:
                common += 1
        del self.path[common + 1 :], self.costs[common + 1 :]
        for c in sign[common:]:
            layer, more, _ = step(self.layers[self.path[-1]], c)
            if layer not in self.number:
                self.number[layer] = len(self.layers)
                self.layers.append(layer)
            self.path.append(self.number[layer])
            self.costs.append(self.costs[-1] + more)
            self.made += 1
        self.sign = sign
        cost, end, last = finish(self.layers[self.path[-1]])
        letters = [last]
        for k in range(len(sign), 0, -1):
            end, by = step(self.layers[self.path[k - 1]], sign[k - 1])[2][end]
            letters.append(by)
        return self.costs[-1] + cost, "".join(reversed(letters))


def parts(rows: DataFrame, conv: str, turn: str, role: str, text: str, present: str | None) -> DataFrame:
    """(id, turn, role, text, present) without nulls in role and text; absent rows have no text."""
    there = F.lit(True) if present is None else F.coalesce(F.col(present), F.lit(False))
    field = lambda c: F.when(there, F.coalesce(F.col(c), F.lit(" "))).otherwise("")
    return rows.select(F.col(conv).alias("id"), F.when(there, F.col(turn)).cast("long").alias("turn"), field(role).alias("role"), field(text).alias("text"), there.alias("present"))


def fault() -> Column:
    """b (blank), t (truncated) or k, from the text alone."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    return F.when(bare == "", "b").when(F.right(bare, F.lit(1)).isin(*ENDS), "k").otherwise("t")


def signatures(rows: DataFrame) -> DataFrame:
    """(id, sign, gaps, blank, duplicate, truncated, illegal) of each conversation of ``parts``."""
    mine = rows.withColumn("fault", fault()).withColumn("key", F.sha2("text", 256)).repartition("id")
    seen = F.row_number().over(Window.partitionBy("id", "present", "role", "key").orderBy(F.asc_nulls_first("turn")))
    marked = mine.withColumn("fault", F.when(~F.col("present"), "-").when((F.col("fault") != "b") & (seen > 1), "d").otherwise(F.col("fault")))
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    # of equal rows the first seen one comes first
    order = ["id", F.asc_nulls_first("turn"), "role", "text", F.col("fault") == "d"]
    inline = marked.sortWithinPartitions(*order).select("id", "turn", initial.alias("initial"), "fault")
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal")
    kind = StructType([rows.schema["id"], StructField("sign", StringType()), *(StructField(c, LongType()) for c in longs)])
    schema = to_arrow_schema(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, open_ = None, False
        roles, faults, turns = [], [], [None, None, 0]  # of the conversation: initials, faults; least, last and number of its turns

        def done() -> tuple:
            r, f = "".join(roles), "".join(faults)
            sign = "".join("D" if y in "bd" else x.upper() if y == "t" else x for x, y in zip(r, f, strict=True))
            gaps = min(turns[1] - turns[0] + 1 - turns[2], 2**63 - 1) if turns[2] else 0
            pairs = sum(r.count(p) for p in LEGAL)  # none overlaps itself
            return at, sign, gaps, f.count("b"), f.count("d"), f.count("t"), max(len(r) - 1, 0) - pairs

        for batch in batches:
            out = []
            for i, turn, x, y in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if not open_ or i != at:
                    if open_:
                        out.append(done())
                    at, open_, roles, faults, turns = i, True, [], [], [None, None, 0]
                if y == "-":
                    continue
                roles.append(x)
                faults.append(y)
                if turn is not None and turn != turns[1]:
                    turns = [turn if turns[0] is None else turns[0], turn, turns[2] + 1]
            if out:
                yield batch_of(out, schema)
        if open_:
            yield batch_of([done()], schema)

    return inline.mapInArrow(run, kind)


def answered(signed: DataFrame) -> DataFrame:
    """``signed`` (stored: ranges are sampled from it) with cost and audit, from the tries of sorted ranges."""
    n = max(2, int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = signed.withColumn("salt", F.expr(f"pmod(xxhash64(id), {SALTS})"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, last, answer = Walk(), None, None
        for batch in batches:
            found = []
            for sign in batch.column(batch.schema.get_field_index("sign")).to_pylist():
                if sign != last:
                    last, answer = sign, walk.answer(sign)
                found.append(answer)
            cols = [pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, "cost", "audit"])

    kind = StructType([*signed.schema.fields, StructField("cost", LongType()), StructField("audit", StringType())])
    return salted.repartitionByRange(n, "sign", "salt").sortWithinPartitions("sign").drop("salt").mapInArrow(run, kind)


def edited(texts: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str, str]]:
    """(letter, role, text) of the rows that the edits leave or insert; ``texts`` gives the rows' role and text in order."""
    end = NOTHING
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(texts)
        if letter == "D":
            continue
        if letter == "K":
            end = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
        else:
            end = DUE[end]
            role = NAMES[end]
        yield letter, role, text


def beside(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Each conversation's answer before its rows, in one task and in order."""
    stats = [c for c in answers.columns if c not in ("id", "sign")]
    heads = answers.select("id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), *stats)
    body = rows.filter("present").select("id", F.lit(1).alias("kind"), "turn", "role", "text", *[F.lit(None).cast(answers.schema[c].dataType).alias(c) for c in stats])
    return heads.unionByName(body).repartition("id").sortWithinPartitions("id", "kind", F.asc_nulls_first("turn"), "role", "text").drop("kind", "turn")


def _streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple[str, str]]]]:
    """(the answer's columns, its rows' role and text) of each conversation; rows are read as they are asked for."""
    each = (row for batch in batches for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)) for row in zip(*(c.to_pylist() for c in part.columns), strict=True))
    head = next(each, None)
    while head is not None:
        following: list = [None]

        def texts() -> Iterator[tuple[str, str]]:
            for row in each:
                if row[1] is None:  # only answers have no role
                    following[0] = row
                    return
                yield row[1], row[2]

        mine = texts()
        yield head, mine
        for _ in mine:
            pass
        head = following[0]


def digested(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """``answers`` with repaired_sha256, the SHA-256 of the repaired ``role:text`` lines."""
    both = beside(rows, answers)
    stats = both.columns[3:]
    kind = StructType([both.schema["id"], *(both.schema[c] for c in stats), StructField("repaired_sha256", StringType())])
    schema, audit = to_arrow_schema(kind), 3 + stats.index("audit")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for head, texts in _streamed(batches):
            h, first = hashlib.sha256(), True
            for _, role, text in edited(texts, head[audit]):
                h.update(("" if first else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                first = False
            out.append((head[0], *head[3:], h.hexdigest()))
            if len(out) >= 1000:
                yield batch_of(out, schema)
                out = []
        if out:
            yield batch_of(out, schema)

    return both.mapInArrow(run, kind)


def audits(rows: DataFrame) -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation of ``parts``."""
    return answered(stored(signatures(rows), "signatures")).drop("sign")


def repair(df: DataFrame, conv: str, turn: str, role: str, text: str, present: str | None = None) -> DataFrame:
    """(``conv``, position, edit, role, text): the rows of the repaired conversations, from 0 in each."""
    rows = parts(df, conv, turn, role, text, present)
    both = beside(rows, audits(rows).select("id", "audit"))
    kind = StructType([StructField(conv, both.schema["id"].dataType), StructField("position", LongType()), *(StructField(c, StringType()) for c in ("edit", "role", "text"))])
    schema = to_arrow_schema(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for head, texts in _streamed(batches):
            for k, (letter, r, t) in enumerate(edited(texts, head[3])):
                out.append((head[0], k, letter, r, t))
                if len(out) >= 1000:
                    yield batch_of(out, schema)
                    out = []
        if out:
            yield batch_of(out, schema)

    return both.mapInArrow(run, kind)


def report(df: DataFrame, conv: str, turn: str, role: str, text: str, present: str | None = None) -> DataFrame:
    """(``conv``, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation."""
    rows = parts(df, conv, turn, role, text, present)
    return digested(rows, audits(rows)).withColumnRenamed("id", conv)


def damaged(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``df``'s four columns with faults put in by crc32 of ``conv:turn``, and ``present``, false for a row that is dropped."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    which = F.crc32(F.concat(shown(conv), F.lit(":"), shown(turn)).cast("binary")) % 20
    rows = df.select(conv, turn, F.coalesce(F.col(role), F.lit(" ")).alias("role_"), F.coalesce(F.col(text), F.lit(" ")).alias("text_"), which.alias("which_"))
    done = rows.select(
        conv, turn,
        F.when(F.col("which_") == 4, "user").otherwise(F.col("role_")).alias(role),
        F.when(F.col("which_") == 1, "").when(F.col("which_") == 2, F.translate("text_", ENDS, "")).otherwise(F.col("text_")).alias(text),
        (F.col("which_") != 0).alias("present"), F.when(F.col("which_") == 3, 2).otherwise(1).alias("times_"),
    )
    return done.withColumn("times_", F.explode(F.sequence(F.lit(1), "times_"))).drop("times_")
