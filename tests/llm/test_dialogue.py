"""Conversation repair against an exhaustive search, and the query against a plain walk through the contract."""

import hashlib
import itertools
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow.parquet as pq
import pytest

from silt.llm import dialogue as d
from silt.llm import queries

SF = "/root/testdata/sf0.001"


def slow(sign):
    """Cheapest letters by search over all of up to len + 3 inserts, the least in ASCII order."""
    due = {"": "u", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(k, last, left):
        ways = [(0, "")] if k == len(sign) and last in ("", "a") else []
        if left:
            c, x = best(k, due[last], left - 1)
            ways.append((5 + c, "I" + x))
        if k < len(sign):
            c, x = best(k + 1, last, left)
            ways.append((2 + c, "D" + x))
            r = sign[k].lower()
            if sign[k] != "D":
                more = 5 * sign[k].isupper()
                if r in "sua" and last + r in ("s", "u", "su", "ua", "au"):
                    c, x = best(k + 1, r, left)
                    ways.append((more + c, "K" + x))
                c, x = best(k + 1, due[last], left)
                ways.append((1 + more + c, "R" + x))
        return min(ways, default=(10**9, ""))

    return best(0, "", len(sign) + 3)


def test_answers_equal_a_search_over_all_edits():
    signs = ["".join(s) for n in range(5) for s in itertools.product("suaoSUAOD", repeat=n)]
    rng = np.random.default_rng(1)
    signs += ["".join(rng.choice(list("suaoSUAOD"), rng.integers(5, 14))) for _ in range(2000)]
    signs = sorted(signs)
    walk = d.Walk()
    for s in signs:
        assert walk.answer(s) == slow(s), s
    assert walk.made < sum(map(len, signs)) * 0.7  # layers of shared prefixes are made once
    assert len(walk.layers) < 500


def test_a_long_signature():
    cost, audit = d.Walk().answer("su" + "aU" * 50_000 + "a")
    assert len(audit) >= 100_003 and cost > 0


def test_role_orders_are_legal():
    for s in map("".join, itertools.product("suaSD", repeat=4)):
        _, audit = d.Walk().answer(s)
        rows = iter([({"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "x"), "t") for c in s])
        assert re.fullmatch(r"(s?(ua)+)?", "".join(r[0] for _, r, _ in d.edited(rows, audit)))


def plain(rows):
    """The contract's columns for (conv, turn, role, text) rows, conversation by conversation."""
    blank = re.compile(r"[^\x20\x09-\x0D]")
    convs = {}
    for conv, turn, role, text in rows:
        mine = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if what == 0:
            continue
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        mine += [(turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    out = {}
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in mine:
            real = blank.findall(text)
            faults.append("b" if not real else "d" if (role, text) in seen else "k" if real[-1] in ".!?" else "t")
            seen.add((role, text))
        first = [r[1][:1] if r[1][:1] in ("s", "u", "a") else "o" for r in mine]
        sign = "".join("D" if f in "bd" else c.upper() if f == "t" else c for c, f in zip(first, faults))
        cost, audit = slow(sign)
        left = list(d.edited(iter([r[1:] for r in mine]), audit))
        turns = {r[0] for r in mine if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in left).encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_op12(spark):
    t = pq.read_table(f"{SF}/conversations.parquet").to_pydict()
    got = queries.QUERIES["op12_conversation_repair"](spark, SF).collect()
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got} == plain(zip(t["conv_id"], t["turn"], t["role"], t["text"], strict=True))


def test_op12_on_odd_rows(spark, tmp_path):
    """Nulls in every column, ties, repeated rows, unknown roles, a long conversation and a very long text; extra columns with clashing names."""
    rng = np.random.default_rng(5)
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (7, None, "user", "a."), (7, 1, None, "b!"), (7, 1, "assistant", "c?"), (7, 1, "assistant", "c?"), (8, 5, "", " \t\n"), (9, 1, "tool", "x"), (9, 9, "user", "x.")]
    rows += [(10 + c, int(k), str(rng.choice(["system", "user", "assistant", "tool"])), str(rng.choice(["yes.", "no", "", "why?", " ", "ok!\x0b"]))) for c in range(60) for k in rng.integers(0, 12, 9)]
    rows += [(100, k, ("user", "assistant")[k % 2], f"turn {k}.") for k in range(3000)] + [(101, 1, "user", "word " * 300_000 + ".")]
    schema = "conv_id long, turn long, role string, text string"
    extra = [(*r, 1, "x", None) for r in rows]
    spark.createDataFrame(extra, schema + ", id int, sign string, present boolean").write.parquet(f"{tmp_path}/some/conversations.parquet")
    got = queries.QUERIES["op12_conversation_repair"](spark, f"{tmp_path}/some")
    long = [r for r in rows if r[0] == 100]
    want = plain([r for r in rows if r[0] != 100])
    have = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got.collect()}
    assert {k: v for k, v in have.items() if k != 100} == want
    assert len(have[100][6]) >= 2700 and have[100][0] == sum(zlib.crc32(f"100:{r[1]}".encode()) % 20 == 0 for r in long)
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert queries.QUERIES["op12_conversation_repair"](spark, f"{tmp_path}/none").collect() == []


def test_all_rows_dropped(spark):
    rows = spark.createDataFrame([(1, 1, "user", "a.", False), (1, 2, "user", "b.", False), (2, 1, "user", "a.", True)], "c long, t long, r string, x string, present boolean")
    got = {r.c: r for r in d.report(rows, "c", "t", "r", "x", "present").collect()}
    assert tuple(got[1][1:]) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) and got[2].audit == "D"


def test_repaired_rows(spark):
    rows = spark.createDataFrame([(1, 1, "system", "s."), (1, 2, "assistant", "hello."), (1, 3, "user", "q?"), (1, 4, "assistant", "a."), (1, 4, "assistant", "a.")], "c long, t long, r string, x string")
    got = [tuple(r)[1:] for r in sorted(d.repair(rows, "c", "t", "r", "x").collect(), key=lambda r: r.position)]
    assert got == [(0, "R", "user", "s."), (1, "K", "assistant", "hello."), (2, "K", "user", "q?"), (3, "K", "assistant", "a.")]


@pytest.mark.parametrize("n", [2, 7])
def test_tries_of_any_number_of_ranges_agree(spark, n):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", n)
        signs = ["".join(s) for k in range(4) for s in itertools.product("suaUD", repeat=k)] * 2
        signed = spark.createDataFrame(list(enumerate(signs)), "id long, sign string")
        got = d.answered(signed).collect()
        assert len(got) == len(signs) and all((r.cost, r.audit) == slow(r.sign) for r in got)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
