"""Walks, element and cell readers, and file sinks on small trees."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from silt.sources import readers, sinks, walk


@pytest.fixture
def tree(tmp_path):
    for d in ("a/b", "a/.git/x", "ab", "c"):
        (tmp_path / d).mkdir(parents=True)
    for f in ("a/one.txt", "a/b/two.txt", "a/.git/x/no.txt", "ab/three.txt", "c/four.txt"):
        (tmp_path / f).write_text(f)
    os.symlink(tmp_path / "a/one.txt", tmp_path / "c/link.txt")
    os.symlink(tmp_path / "a", tmp_path / "c/linked")
    os.symlink(tmp_path / "nowhere", tmp_path / "c/broken")
    return tmp_path


def test_walk(spark, tree, monkeypatch):
    names = lambda df: sorted(os.path.relpath(r.path, tree) for r in df.select("path").collect())
    files, failed = walk.walk(spark, str(tree), without=["/.git"])
    assert names(files) == ["a/b/two.txt", "a/one.txt", "ab/three.txt", "c/four.txt"] and failed.count() == 0
    r = files.filter(F.col("path").endswith("one.txt")).first()
    assert r["size"] == 9 and r.modified > 0 and r.accessed > 0 and r.changed > 0
    for k, f in enumerate(("c/four.txt", "a/one.txt", "ab/three.txt")):  # the link has the time of a/one.txt
        os.utime(tree / f, (k + 1, k + 1))
    files, _ = walk.walk(spark, str(tree), excluded=[str(tree / "a")], links=True)
    assert names(files) == ["ab/three.txt", "c/four.txt", "c/link.txt"]
    assert names(walk.latest(files, n=2)) == ["ab/three.txt", "c/link.txt"]
    lines = spark.createDataFrame([("/proc",), ("# note",), (" ",), (" /sys ",)], "line string")
    assert sorted(walk.prefixes(lines)) == ["/proc", "/sys"]


def test_a_walk_tells_what_failed(spark, tree):
    files, failed = walk.walk(spark, str(tree / "gone"))
    assert files.count() == 0 and [r.path for r in failed.collect()] == [str(tree / "gone")]


def test_xml_elements(spark, tmp_path):
    (tmp_path / "ok.xml").write_text('<a z="1" b="2"> <c>x<d/>y</c>\n<e> </e></a>')
    (tmp_path / "bad.xml").write_text("<a><b>t</b><")
    rows = readers.xml_elements(spark, str(tmp_path)).collect()
    ok = [(r.pos, r.depth, r.parent, r.tag, r.attributes, r.text) for r in sorted(rows, key=lambda r: r.pos) if r.path.endswith("ok.xml")]
    assert ok == [(0, 0, None, "a", {"b": "2", "z": "1"}, None), (1, 1, 0, "c", {}, "xy"), (2, 2, 1, "d", {}, None), (3, 1, 0, "e", {}, None)]
    assert [r.tag for r in rows if r.path.endswith("bad.xml")][:1] == ["a"]


def test_workbook_cells(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "book.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>hello</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1"><v>7.0</v></c><c r="C1"/></row><row r="2"><c r="B2" t="s"><v>1</v></c><c r="C2" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>')
    (tmp_path / "no.xlsx").write_text("nothing")
    got = {(r.sheet, r.row, r.col, r.value) for r in readers.workbook_cells(spark, str(tmp_path)).collect()}
    assert got == {("S", 1, 1, "hello"), ("S", 1, 28, "7"), ("S", 2, 2, "two runs"), ("S", 2, 3, "in")}


def test_binary_files(spark, tmp_path):
    df = spark.createDataFrame([("a.bin", bytearray(b"\x00\x01")), ("b.bin", None)], "n string, c binary")
    sinks.binary_files(df, str(tmp_path / "out"), "n", "c")
    assert (tmp_path / "out/a.bin").read_bytes() == b"\x00\x01" and (tmp_path / "out/b.bin").read_bytes() == b""


def test_perceptual_hash_and_black_frames(spark):
    import numpy as np

    from silt.functions import media

    rng = np.random.default_rng(1)
    smooth = np.kron(rng.random((8, 8)), np.ones((4, 4))) * 255
    near, other = smooth + rng.standard_normal((32, 32)), rng.random((32, 32)) * 255
    rows = [(i, x.ravel().tolist()) for i, x in enumerate((smooth, near, other))] + [(3, [1.0]), (4, None)]
    df = spark.createDataFrame(rows, "i int, p array<double>")
    got = {r.i: r.h for r in df.select("i", media.perceptual_hash("p").alias("h")).collect()}
    x = np.arange(32)
    low = [sum(near[a, b] * np.cos(np.pi * u * (2 * a + 1) / 64) * np.cos(np.pi * v * (2 * b + 1) / 64) for a in x for b in x) for u in range(8) for v in range(8)]
    assert [got[1] >> (63 - k) & 1 for k in range(64)] == [int(v > np.median(low)) for v in low]
    apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert apart(got[0], got[1]) <= 10 < apart(got[0], got[2]) and got[3] is None and got[4] is None
    films = spark.createDataFrame([("a", 0, [0, 9]), ("a", 1, [10, 10]), ("a", 2, [99]), ("b", 0, [0])], "f string, k int, p array<int>")
    assert [(r.f, r.k) for r in media.first_lit(films, ["f"], [F.col("k")], "p").collect()] == [("a", 1)]


def test_terminal_html_and_templates(spark):
    from silt.functions import text as T

    show = lambda t: spark.range(1).select(T.ansi_html(F.lit(t)).alias("x")).first().x
    assert show("a\x1b[31m<b>\x1b[4;44mc\x1b[39md\x1b[me\x1b[2J") == 'a<span style="color:#aa0000">&lt;b&gt;</span><span style="background-color:#0000aa;color:#aa0000;text-decoration:underline">c</span><span style="background-color:#0000aa;text-decoration:underline">d</span>e'
    assert show("\x1b[38;5;196mx\x1b[38;5;244my") == '<span style="color:#ff0000">x</span><span style="color:#808080">y</span>'
    lay = lambda t: spark.range(1).select(T.laid_out(F.lit(t)).alias("x")).first().x
    assert lay("a<b<c, d>>") == "a<b<c, d>>" and lay("f<x") == "f<x"
    assert lay("m<k, p<x,y>, v<q>>, z") == "m<\n  k,\n  p<\n    x,\n    y\n  >,\n  v<q>\n>,\nz"


def test_changed_files_come_once(spark, tmp_path):
    from silt.streaming import stateful

    (tmp_path / "in").mkdir()
    for n in ("a.txt", "b.txt", "c.log"):
        (tmp_path / "in" / n).write_text(n)
    seen = lambda: sorted(os.path.basename(r.path) for r in stateful.run_once(stateful.changed_files(spark, str(tmp_path / "in"), "*.txt", 1), "append", str(tmp_path / "state"), str(tmp_path / "out")).collect())
    assert seen() == ["a.txt", "b.txt"]
    (tmp_path / "in/d.txt").write_text("d")
    assert seen() == ["a.txt", "b.txt", "d.txt"]


def slow_layout(text, pad=0):
    """Templates by recursion, as a check of the layout by a stack."""

    def close(at):
        depth = 0
        for k in range(at, len(text)):
            depth += (text[k] == "<") - (text[k] == ">")
            if depth == 0:
                return k
        return -1

    parts, at = [""], 0
    while at < len(text):
        end = close(at) if text[at] == "<" else -1
        if end > 0:
            inner, depth, begin = [], 0, at + 1
            for k in range(at + 1, end + 1):
                if depth == 0 and (text[k] == "," or k == end):
                    inner.append(text[begin:k])
                    begin = k + 1
                depth += (text[k] == "<") - (text[k] == ">")
            gap = "\n" + " " * (pad + 2)
            parts[-1] += text[at : end + 1] if len(inner) == 1 else "<" + gap + f",{gap}".join(slow_layout(p.removeprefix(" ") if i else p, pad + 2) for i, p in enumerate(inner)) + "\n" + " " * pad + ">"
            at = end + 1
        elif text[at] == ",":
            at += 2 if text[at + 1 : at + 2] == " " else 1
            parts.append("")
        else:
            parts[-1] += text[at]
            at += 1
    return (",\n" + " " * pad).join(parts)


def test_template_layout_of_any_depth():
    import random

    from silt.functions.text import _laid_out

    rng = random.Random(3)
    for _ in range(3000):
        t = "".join(rng.choice("<>,, ab") for _ in range(rng.randrange(18)))
        assert _laid_out(t) == slow_layout(t), t
    deep = _laid_out("a<b," * 3000 + ">" * 3000)
    assert deep.count("\n") == 9000
    assert len(_laid_out("<" * 100_000)) == 100_000  # none is closed
