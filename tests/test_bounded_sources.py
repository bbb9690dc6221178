"""Sources of any size: ranges of captures begin at records, whatever looks like a header; folders are listed in batches."""

import struct

import pyarrow as pa

from silt.sources import captures, walk


def test_headers_by_chance_begin_no_range(tmp_path):
    """With such times the byte before a record and its header look like a header too, whose length may lead to a record."""
    raw = bytearray(bytes.fromhex("D4C3B2A1020004000000000000000000FFFF000001000000"))
    n = 30_000
    for i in range(n):
        frame = b"x" * (8 + i * 7 % 13)
        raw += struct.pack("<IIII", 1_700_000_000 + 45 * i, 0, len(frame), len(frame)) + frame
    (tmp_path / "a.pcap").write_bytes(raw)
    reader = captures.CaptureReader(str(tmp_path), 4096)
    parts = reader.partitions()
    assert len(parts) > 200 and sum(b.num_rows for p in parts for b in reader.read(p)) == n


def test_captures_of_many_years(tmp_path):
    times = [1_000_000_000 + i * 5_000_000 for i in range(500)]
    raw = bytes.fromhex("D4C3B2A1020004000000000000000000FFFF000001000000") + b"".join(struct.pack("<IIII", t, 0, 40, 40) + b"frame" * 8 for t in times)
    (tmp_path / "a.pcap").write_bytes(raw)
    reader = captures.CaptureReader(str(tmp_path), 700)
    got = [x for p in reader.partitions() for b in reader.read(p) for x in b.column("seconds").to_pylist()]
    assert got == times


def test_ranges_are_bounded_in_number(tmp_path):
    (tmp_path / "a.pcap").write_bytes(bytes(1_000_000))
    assert len(captures.CaptureReader(str(tmp_path), 97).partitions()) <= captures.MOST + 1


def test_a_folder_is_listed_in_bounded_batches(tmp_path):
    for i in range(2 * walk.ROWS + 5):
        (tmp_path / f"{i}.txt").touch()
    found = [b.num_rows for b in walk._lister((), (), False, False)([pa.RecordBatch.from_arrays([pa.array([str(tmp_path)])], names=["path"])])]
    assert sum(found) == 2 * walk.ROWS + 5 and max(found) <= walk.ROWS
