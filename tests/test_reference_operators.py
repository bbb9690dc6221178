"""Golden values, blocked joins against brute force, and every registered query against DuckDB."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from silt.functions import text as T
from silt.operators import assign, catalog, graph, series, similarity, stats
from silt.plans import load_all, registry
from silt.sources import readers, sinks
from tests.compare import compare, duck

load_all()
SF = "/root/testdata/sf0.001"
#: Queries without rows at this size.
MAY_BE_EMPTY = {"stream_rates"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_duckdb(spark, con, name):
    why = compare(spark, con, registry.QUERIES[name], registry.ORACLES[name], SF)
    assert why == "" or (why == "no rows" and name in MAY_BE_EMPTY)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_have_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_summary_golden(spark):
    r = stats.summary(spark.range(1, 101).withColumn("k", F.lit(1)), ["k"], "id").first()
    assert (r.mean, r.median, r.min, r.max) == (50.5, 50.5, 1, 100)
    assert r.sd_pop == pytest.approx(28.86607, abs=1e-5) and r.sd_samp == pytest.approx(29.01149, abs=1e-5) and round(r.cv_pct, 1) == 57.4
    assert stats.summary(spark.range(1).withColumn("k", F.lit(1)), ["k"], "id").first().sd_samp == 0


def test_weighted_golden(spark):
    r = stats.weighted(spark.range(10).withColumn("w", F.lit(1)).withColumn("k", F.lit(1)), ["k"], "id", "w").first()
    assert r["mean"] == 4.5 and r["var_pop"] == pytest.approx(8.25)
    assert stats.log_edges(0, 255, 8) == [1, 3, 7, 15, 31, 63, 127, 255]


def test_dice_and_lcs_golden(spark):
    a, b = (T.tokens(F.lit(t)) for t in ("Lesson 01", "Lesson 01 - jtag"))
    r = one(spark, T.weighted_dice(a, b).alias("d"), T.lcs(a, b).alias("l"), T.lcs(F.split(F.lit("a b c b d a b"), " "), F.split(F.lit("b d c a b a"), " ")).alias("m"))
    assert r.d == pytest.approx(6 / 7) and r.l == 2 and r.m == 4


def test_mad_of_zero_takes_all_off_the_median(spark):
    df = spark.createDataFrame([(1, 5.0)] * 9 + [(1, 6.0)], "k int, x double")
    assert [r.x for r in stats.mad_outliers(df, ["k"], "x").collect()] == [6.0]
    assert [r.x for r in stats.mad_outliers(spark.createDataFrame([(1, float(x)) for x in (1, 2, 3, 4, 100)], "k int, x double"), ["k"], "x").collect()] == [100.0]


def test_histograms_disagree_on_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 2, 4, 5, 10)], "x double")
    assert [r.cnt for r in stats.histogram(df, "x", 0, 10, 5).orderBy("bin").collect()] == [2, 1, 1, 0, 1]
    assert [r.cnt for r in stats.histogram(df, "x", 0, 10, 5, "left").orderBy("bin").collect()] == [1, 1, 2, 0, 1]
    with pytest.raises(ValueError):
        stats.histogram(df, "x", 1, 1, 5)


def test_log_gaps_golden(spark):
    df = spark.createDataFrame([("a", t) for t in ("04:06:47", "04:13:05", "04:19:24", "04:25:42")], "k string, t string")
    us = F.unix_micros(F.to_timestamp(F.concat(F.lit("2020-01-01 "), "t")))
    assert [r.gap_us for r in series.gaps(df, ["k"], ["t"], us).orderBy("t").collect()] == [None, 378e6, 379e6, 378e6]


def test_text_functions(spark):
    r = one(
        spark,
        T.stem(F.lit("x.tar.GZ")).alias("a"), T.stem(F.lit(".bashrc")).alias("b"), T.nth(F.lit(" p q  r "), -1).alias("c"), T.nth(F.lit("p"), 3).alias("d"),
        T.url_decoded(F.lit("a+b%20c")).alias("e"), T.html_unescaped(F.lit("a&lt;b")).alias("f"), T.unicode_unescaped(F.lit("\\u0041b")).alias("g"), T.hex_unescaped(F.lit("\\x41b")).alias("h"),
        T.mime_decoded(F.lit("=?utf-8?q?caf=C3=A9?=")).alias("i"), T.compact_minutes(F.lit(1500)).alias("j"), T.real_seconds(F.lit("real 2m03.5s")).alias("k"), T.scaled(F.lit(2048)).alias("l"),
        T.shortened(F.lit("abcdefghij"), 6).alias("m"), T.epoch_text(F.lit(1231231231)).alias("n"), T.attribute(F.lit("<a HREF='x'> <b href=\"y\">"), "href").alias("o"),
    )
    assert tuple(r)[:3] == ("x.tar", ".bashrc", "r") and r.d is None
    assert (r.e, r.f, r.g, r.h, r.i) == ("a+b c", "a<b", "Ab", "Ab", "café")
    assert (r.j, r.k, r.l, r.m, r.n, r.o) == ("1d", 123, "2k", "...hij", "08:40:31-2009/01/06", ["x", "y"])


def test_number_policies(spark):
    df = spark.createDataFrame([(0, "1"), (1, " 2 "), (2, "x"), (3, "4"), (4, "")], "pos long, line string")
    get = lambda p: [r.value for r in readers.numbers(df, p).orderBy("pos").collect()]
    assert get("skip") == [1, 2, 4] and get("stop") == [1, 2] and get("zero") == [1, 2, 0, 4, 0]
    with pytest.raises(Exception):
        readers.numbers(df, "raise").collect()
    w = readers.weighted_points(spark.createDataFrame([("1.5 2",), ("bad",)], "line string")).first()
    assert (float(w.value), w["count"]) == (1.5, 2)


def test_allow_list(spark):
    df = spark.createDataFrame([(t,) for t in ("1.2.3.4", "1.2.3.4:80", "10.0.0.0/8", "[::1]:443", "host.example:22", "# no", "h:99999")], "line string")
    got = {(r.kind, r.host, r.port) for r in readers.allow_list(df).collect()}
    assert got == {("v4", "1.2.3.4", None), ("v4", "1.2.3.4", 80), ("cidr", "10.0.0.0/8", None), ("v6", "::1", 443), ("host", "host.example", 22), ("host", "h", None)}


def test_captions_files_and_reports(spark, tmp_path):
    (tmp_path / "a.vtt").write_text("WEBVTT\nKind: x\n\n00:00:01.000 --> 00:00:02.000 align:start\nHello <c>big</c> world\n\n00:00:02.000 --> 00:00:03.000\nworld &amp; all\n")
    got = readers.captions(spark, str(tmp_path / "a.vtt")).orderBy("pos").collect()
    assert [(r.start, r.text) for r in got] == [("00:00:01.000", "Hello big world"), ("00:00:02.000", "world & all")]
    assert readers.files(spark, str(tmp_path), ["VTT"], 10).count() == 1 and readers.files(spark, str(tmp_path), ["txt"]).count() == 0
    assert readers.digests(spark, str(tmp_path)).first().md5
    (tmp_path / "c.csv").write_bytes("n;v\ncaf\xe9;1\n".encode("latin-1"))
    assert readers.csv_strings(spark, str(tmp_path / "c.csv"), ";").first().n == "café"
    sinks.lines(spark.createDataFrame([("a", "b")], "x string, y string"), str(tmp_path / "out"), sinks.existing_line("x", "y"), "\0")
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("part-*")) == "a###b\0"
    rows = spark.createDataFrame([("<a>", None)], "x string, y string").select(sinks.html_rows(["x", "y"]).alias("h"))
    assert rows.first().h == "<tr><td>&lt;a&gt;</td><td></td></tr>"
    ev = spark.createDataFrame([('{"type":"tool","toolName":"ls"}',), ("oops",), ('{"type":"turn_end"}',)], "line string")
    assert [(r.kind, r.detail) for r in readers.routed_events(ev).collect()] == [("tool", "ls")]


def expanded(pairs, values):
    """All pairs that follow from pairs between classes of equal values and their memberships."""
    same, out = {}, set()
    for i, v in enumerate(values):
        same.setdefault(v, []).append(i)
    least = {i: min(g) for g in same.values() for i in g}
    assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)
    inside = {(a, b) for a, b in pairs if least[a] == least[b]}
    assert inside == {(min(g), i) for g in same.values() for i in g if i != min(g)}
    for a, b in set(pairs) - inside:
        assert a == least[a] and b == least[b]
        out |= {(min(i, j), max(i, j)) for i in same[values[a]] for j in same[values[b]]}
    return out | {p for g in same.values() for p in combinations(sorted(g), 2)}


def test_hamming_and_bands_equal_brute_force(spark):
    import random

    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(30)]
    hs = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(12))) % 2**64 for b in base for _ in range(4)]
    hs += hs[:5]
    signed = [h - 2**64 if h >= 2**63 else h for h in hs]
    df = spark.createDataFrame([*enumerate(signed), (999, None)], "n long, h long")
    for most in (0, 2, 10):
        want = {(i, j) for i, j in combinations(range(len(hs)), 2) if (hs[i] ^ hs[j]).bit_count() <= most}
        got = similarity.hamming_pairs(df, "n", "h", most).collect()
        assert expanded([(r.a, r.b) for r in got], hs) == want and want
        assert all((hs[r.a] ^ hs[r.b]).bit_count() == r.distance for r in got)
    changed = {3, 7, 50}
    some = similarity.hamming_pairs(df, "n", "h", 10, df.filter(F.col("n").isin(*changed))).collect()
    hot = {hs[i] for i in changed}
    assert sorted((r.a, r.b) for r in some) == sorted((r.a, r.b) for r in got if {hs[r.a], hs[r.b]} & hot)
    xs = [rng.uniform(-50, 50) for _ in range(150)] + [3.0, 6.0, 6.0]
    df = spark.createDataFrame(list(enumerate(xs)), "n long, x double")
    got = [(r.a, r.b) for r in similarity.band_pairs(df, "n", "x", 3.0).collect()]
    assert expanded(got, xs) == {(i, j) for i, j in combinations(range(len(xs)), 2) if abs(xs[i] - xs[j]) <= 3.0}


def test_edit_pairs_equal_brute_force(spark):
    import random

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    rng = random.Random(2)
    names = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(12))) for _ in range(70)} | {"", "a", "kätzchen", "kätzchem"})
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "name string")
    for percent in (0, 20, 30, 60):
        want = {(x, y, edits(x, y)) for x in names for y in names if edits(x, y) <= max(1, len(x) * percent // 100)}
        assert {tuple(r) for r in similarity.edit_pairs(df, df, "name", percent).collect()} == want


def test_components_of_a_star_and_a_path(spark):
    edges = [(0, 1), (0, 2)] + [(10 + i, 11 + i) for i in range(20)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in (0, 1, 2)} == {0} and {got[i] for i in range(10, 31)} == {10}


def test_sequential_operators(spark):
    items = spark.createDataFrame([("a", s) for s in (60, 50, 30, 30)], "k string, s int")
    assert assign.subset_sum(items, ["k"], "s", 100).first().filled == 90
    pairs = spark.createDataFrame([("g", "a", "x", 0.9), ("g", "b", "x", 0.95), ("g", "b", "y", 0.4)], "g string, l string, r string, score double")
    assert {(r.l, r.r) for r in assign.greedy_assignment(pairs, "g").collect()} == {("a", "x"), ("b", "y")}
    caps = spark.createDataFrame([(1, 0, "hello big"), (1, 1, "big world"), (1, 2, "x")], "k long, pos long, t string")
    assert assign.merged_captions(caps, "k", "pos", "t").first().text == "hello big world x"


def test_null_safe_catalogue(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k long, d string")
    b = spark.createDataFrame([(1, None), (2, None), (4, "z")], "k long, d string")
    assert {r.k: r.status for r in catalog.integrity(a, b, ["k"], "d").collect()} == {1: "MATCH", 2: "MISMATCH", 3: "MISSING", 4: "NEW"}
    assert {r.k: r.status for r in catalog.snapshot_diff(a, b, ["k"], ["d"]).collect()} == {1: "SAME", 2: "UPDATE", 3: "DELETE", 4: "INSERT"}
    assert {(r.k, r.d) for r in catalog.upsert(a, b, ["k"]).collect()} == {(1, None), (2, None), (3, "y"), (4, "z")}


def test_throttled_rates_golden(spark):
    rows = [("m", at, n) for at, n in ((1000, 0), (1050, 5), (1260, 13), (1300, 20), (1520, 52), (1769, 99), (1770, 77))]
    got = series.throttled_rates(spark.createDataFrame(rows, "k string, at long, n int"), "k", "at", "n").orderBy("at_ms").collect()
    assert [tuple(r) for r in got] == [("m", 1260, 50), ("m", 1520, 100), ("m", 1770, 100)]


def test_blobs_versions_and_paths(spark, tmp_path):
    import struct
    import zipfile

    (tmp_path / "caps").mkdir()
    for name, order in (("a", "<"), ("b", ">")):
        records = b"".join(struct.pack(f"{order}4I", 1, 2, len(f), len(f)) + f for f in (b"one", b"", b"three"))
        (tmp_path / "caps" / name).write_bytes(struct.pack(f"{order}I2H4I", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + records + b"\0" * 5)
    (tmp_path / "caps" / "c").write_bytes(b"no capture")
    got = readers.frames(spark, str(tmp_path / "caps")).collect()
    assert sorted((r.path[-1], r.pos, bytes(r.frame)) for r in got) == [(n, i, f) for n in "ab" for i, f in enumerate((b"one", b"", b"three"))]
    (tmp_path / "jars").mkdir()
    with zipfile.ZipFile(tmp_path / "jars" / "x.jar", "w") as z:
        z.writestr("p/Main.class", b"1234")
    (tmp_path / "jars" / "y.jar").write_bytes(b"")
    assert [(r.entry, r.size) for r in readers.archive_entries(spark, str(tmp_path / "jars")).collect()] == [("p/Main.class", 4)]
    r = one(
        spark, T.version_key(F.lit("v1.10.x")).alias("a"), T.globbed(F.lit("a_b%c"), "a_*%c").alias("b"), T.globbed(F.lit("axb"), "a_b").alias("c"),
        T.byte_diffs(F.lit("abc"), F.lit("aXcd")).alias("d"), T.byte_diffs(F.lit(""), F.lit("x")).alias("e"), T.top_store(F.lit("/r/.git/modules/a/modules/b")).alias("f"),
        T.sorted_xml(F.lit("<r><b z='1' a='2'>t</b>\n<a/></r>")).alias("g"), T.sorted_xml(F.lit("<r>")).alias("h"),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == ([1, 10, 0], True, False, ["00000002 62 58"], [], "/r/.git")
    assert r.g == '<r>\n   <a></a>\n   <b a="2" z="1">t</b>\n</r>' and r.h is None


def test_subset_sum_gives_the_chosen_items(spark):
    rows = [("a", i, s) for i, s in enumerate((60, 50, 30, 30, 200, 0))] + [("b", 9, 500), ("c", 7, None), ("c", 8, 4)]
    got = {r.k: r for r in assign.subset_sum(spark.createDataFrame(rows, "k string, i int, s int"), ["k"], "s", 100, "i").collect()}
    size = {(k, i): s for k, i, s in rows}
    assert {k: (r.filled, sum(size[k, i] for i in r.chosen), len(set(r.chosen)) == len(r.chosen)) for k, r in got.items()} == {"a": (90, 90, True), "b": (0, 0, True), "c": (4, 4, True)}


def test_wrapping_speakers_and_leaves(spark):
    r = one(
        spark,
        T.wrapped(F.lit("aa bb  ccc\tdddddddddd e"), 6).alias("w"), T.wrapped(F.lit(" "), 6).alias("none"),
        T.speaker_parts(F.lit("so >> hi >> >>yes")).alias("s"), T.clipped(F.lit("a.b.csv")).alias("c"),
        T.disk_result(F.lit("  WRITE: bw=12MiB/s (1)")).alias("d"), T.field_range(F.lit("7f00-7fff rw-p")).alias("f"),
        T.json_leaves(F.lit('{"a": [1.50, {"b": null, "c": "x"}], "d": {"e": [[true, false]]}, "f": []}')).alias("j"), T.json_leaves(F.lit("{")).alias("bad"), T.json_leaves(F.lit("7")).alias("top"),
    )
    assert r.w == "aa bb\nccc\ndddddddddd\ne" and r.none == "" and r.s == ["so", ">> hi", ">> yes"] and r.c == "a"
    assert (r.d.bandwidth, r.d.iops) == ("12MiB/s", None) and (r.f.start, r.f.stop) == ("7f00", "7fff")
    assert [tuple(x) for x in r.j] == [("a.[0]", "1.50"), ("a.[1].c", "x"), ("d.e.[0].[0]", "true")] and r.bad == [] and [tuple(x) for x in r.top] == [("", "7")]


def test_views_fall_back_and_refuse(spark):
    from silt.operators import telemetry

    views = telemetry.Views()
    views.register("a", needs=["x", "y"], instead=["b"])(lambda df: df.select("x"))
    views.register("b", needs=["x"])(lambda df: df.select(F.lit(1).alias("one")))
    df = spark.range(2).withColumnRenamed("id", "x")
    assert views.show(df, "a").columns == ["one"] and views.show(df.withColumn("y", F.lit(0)), "a").columns == ["x"]
    with pytest.raises(LookupError):
        views.show(df.drop("x"), "a")
    with pytest.raises(ValueError):
        views.register("b")(lambda df: df)


def test_lazy_changes_and_reports_without_rows(spark):
    from silt.operators import lines

    now = spark.createDataFrame([(1, 5, 0, "a"), (2, 5, 9, "b"), (3, 5, 9, "c"), (4, 6, 0, "d"), (5, 1, 0, "e"), (6, None, None, None)], "k int, size int, time int, text string")
    old = spark.createDataFrame([(1, 5, 0, "zz"), (2, 5, 0, "b"), (3, 5, 0, "x"), (4, 5, 0, "d"), (6, None, None, None)], "k int, size int, time int, digest string")
    assert {tuple(r) for r in lines.changed_lazily(now, old, "k", "size", "time", F.col("text")).collect()} == {(3, "changed"), (4, "changed"), (5, "new")}
    none = spark.createDataFrame([], "a int, b int")
    assert [r.line for r in lines.duplicate_report(none, "a", "b").collect()] == ["# No duplicates detected."]
    rows = spark.createDataFrame([("NEW", "x"), ("MATCH", "y"), ("other", "z")], "s string, l string")
    assert [r.line for r in lines.validation_report(rows, "s", "l").orderBy("section", "at", "line").collect()] == ["=== MATCH ===", "MATCH: y", "", "=== NEW ===", "NEW: x"]
    assert lines.recent(list("abc"), ["d"], 2) == ["c", "d"] and lines.limited(rows, ["s"], ["l"], -1).count() == 3
