"""Captures read by many tasks, archives by their directories, writers that publish all or nothing."""

import os
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from silt.sources import captures, committed, readers


def capture(path, frames, order="<", nanos=False, cut=0):
    mark = {("<", False): b"\xd4\xc3\xb2\xa1", (">", False): b"\xa1\xb2\xc3\xd4", ("<", True): b"\x4d\x3c\xb2\xa1", (">", True): b"\xa1\xb2\x3c\x4d"}[order, nanos]
    raw = mark + struct.pack(f"{order}HHiIII", 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate(frames):
        raw += struct.pack(f"{order}IIII", 1_700_000_000 + i, i % 1000, len(f), len(f) + 3) + f
    with open(path, "wb") as out:
        out.write(raw[: len(raw) - cut])


@pytest.mark.parametrize("order,nanos", [("<", False), (">", False), ("<", True), (">", True)])
def test_any_split_gives_the_rows_of_one_task(spark, tmp_path, order, nanos):
    rng = random.Random(1)
    frames = [bytes(rng.getrandbits(8) for _ in range(rng.choice([0, 1, 60, 200]))) for _ in range(700)]
    frames[100] = struct.pack(f"{order}IIII", 1, 1, 20, 20) * 12  # headers inside a frame
    capture(tmp_path / "a.pcap", frames, order, nanos, cut=5 if nanos else 0)
    (tmp_path / "b.txt").write_bytes(b"no capture")
    captures.register(spark)
    read = lambda split: spark.read.format("silt_captures").option("path", str(tmp_path)).option("split", split).load()
    one = sorted(map(tuple, read(0).collect()), key=lambda r: r[1])
    whole = frames if not nanos else frames[:-1] if frames[-1] else frames[:-1]
    assert [bytes(r[3]) for r in one] == whole
    for split in (997, 5000):
        many = read(split)
        assert many.rdd.getNumPartitions() > 10
        assert sorted(map(tuple, many.collect()), key=lambda r: r[1]) == one
    assert sorted(bytes(r.frame) for r in readers.frames(spark, str(tmp_path)).collect()) == sorted(whole)


def test_filters_reach_the_reader(spark, tmp_path):
    for n in ("x", "y"):
        capture(tmp_path / f"{n}.pcap", [n.encode() * 10] * 50)
    captures.register(spark)
    df = spark.read.format("silt_captures").option("path", str(tmp_path)).load()
    one = df.filter((F.col("path") == str(tmp_path / "x.pcap")) & (F.col("seconds") >= 1_700_000_010) & (F.col("seconds") < 1_700_000_020))
    assert one.count() == 10 and one.rdd.getNumPartitions() == 1 and {r.path for r in one.collect()} == {str(tmp_path / "x.pcap")}


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.jar", "w") as z:
        z.writestr("META-INF/MANIFEST.MF", "x" * 10)
        z.writestr("d/", "")
        z.writestr("d/e.class", b"\0" * 99)
    (tmp_path / "broken.zip").write_bytes(b"PK\3\4 no")
    captures.register(spark)
    got = spark.read.format("silt_archives").option("path", str(tmp_path)).load()
    assert sorted((os.path.basename(r.path), r.entry, r.size) for r in got.collect()) == [("a.jar", "META-INF/MANIFEST.MF", 10), ("a.jar", "d/e.class", 99)]


def below(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs if not f.startswith("."))


def test_files_come_all_or_not_at_all(spark, tmp_path):
    at = str(tmp_path / "out")
    df = spark.range(50).select(F.concat(F.lit("d/"), F.col("id").cast("string")).alias("n"), F.encode(F.repeat(F.lit("x"), F.col("id").cast("int")), "utf-8").alias("c"))
    committed.write_files(df.repartition(5), at, "n", "c")
    assert len(below(at)) == 50 and os.path.getsize(f"{at}/d/7") == 7 and os.listdir(tmp_path) == ["out"]
    bad = df.withColumn("n", F.when(F.col("n") == "d/31", F.raise_error(F.lit("no"))).otherwise(F.concat(F.lit("e"), "n")))
    for wrong in (bad, df.withColumn("n", F.lit("same")), df.withColumn("n", F.lit("../out"))):
        with pytest.raises(Exception):
            committed.write_files(wrong.repartition(5), at, "n", "c")
        assert len(below(at)) == 50 and os.listdir(tmp_path) == ["out"]  # what was there, and no staging
    committed.write_files(df.limit(3).withColumn("n", F.concat(F.lit("new/"), "n")), at, "n", "c", "append")
    assert len(below(at)) == 53
    committed.write_files(df.limit(2), at, "n", "c")
    assert below(at) == ["d/0", "d/1"]


def test_merged_log_beside_the_streams(spark, tmp_path):
    at = str(tmp_path / "logs")
    rng = random.Random(4)
    rows = [(rng.randrange(1000), rng.choice(["out", "err"]), f"line {i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "t long, s string, x string").repartition(6)
    committed.write_logs(df, at, "s", "t", F.concat_ws(" ", F.lpad(F.col("t").cast("string"), 4, "0"), "s", "x"), parts=5)
    text = lambda d: "".join(open(f"{at}/{d}/{f}").read() for f in sorted(os.listdir(f"{at}/{d}")) if not f.startswith("."))
    want = [f"{t:04d} {s} {x}" for t, s, x in sorted(rows, key=lambda r: (r[0], r[1], f"{r[0]:04d} {r[1]} {r[2]}"))]
    assert text("merged").splitlines() == want and len(os.listdir(f"{at}/merged")) > 3
    for s in ("out", "err"):
        assert text(s).splitlines() == [x for x in want if f" {s} " in x]
