"""Packet captures and archives as Spark data sources.

``silt_captures`` reads the classic capture format, of either byte order and with micro- or nanoseconds. A file is cut into
ranges of ``split`` bytes; a reader streams the records that begin in its range, in buffers of bounded size, so many tasks
read one large file. A range that begins inside a record finds the next one: the first place from which ``CHAIN`` plausible
record headers (of times not long before the first record's) follow one another, or lead to the file's end. It looks from
``BACK`` bytes before the range on and follows what it finds into the range: bytes across two records may look like a header
whose length happens to lead to a record, and such a chain is on true records long before the range begins. Every reader also
checks that the reader after it would begin where its own last record ends; if not, the read fails rather than give other rows
than one task would. A cut-off
last record is left out, a file without the format's header has no records.

``silt_archives`` lists what zip and jar archives hold, from their directories alone: contents are not read.

Comparisons of ``path`` with constants leave out whole files, those of ``seconds`` leave out records before their bytes are
copied. Paths may be anything that Arrow's file systems open, such as a mounted
folder or a Hadoop store; all executors must reach it.
"""

from __future__ import annotations

import struct
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

# The format's marks with byte order and fractions of a second, and the lengths of its headers.
MARKS = {b"\xa1\xb2\xc3\xd4": (">", 1_000_000), b"\xd4\xc3\xb2\xa1": ("<", 1_000_000), b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000), b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000)}
FILE_HEADER, RECORD_HEADER = 24, 16

CHAIN = 64
SPAN = 1 << 26  # seconds that a plausible record may be before the first one: two years, or half of the first one's time
LONGEST = 1 << 18  # bytes of a record, where the file's own bound is 0 or greater
BACK = LONGEST + RECORD_HEADER  # bytes before a range in which at least one record begins
MOST = 1024  # ranges of all files, about; of more, neighbours are read as one
BUFFER, ROWS = 1 << 20, 4096


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str, endings: tuple[str, ...] = ()) -> list[tuple[str, int]]:
    """(path, size) of a file, or of all files below a folder whose names do not begin with _ or a dot."""
    store, at = opened(path)
    info = store.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    shown = [(i.path, i.size) for i in found if i.type == fs.FileType.File and not i.base_name.startswith(("_", "."))]
    return sorted((p, n) for p, n in shown if not endings or p.lower().endswith(endings))


class Stream:
    """Bytes of a file from any place on, through one buffer."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.buffer = file, size, 0, b""

    def at(self, place: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``place``."""
        if place < self.start or place + n > self.start + len(self.buffer):
            self.file.seek(place)
            self.start, self.buffer = place, self.file.read(max(n, BUFFER))
        return self.buffer[place - self.start : place - self.start + n]


@dataclass
class Format:
    order: str
    fraction: int
    longest: int
    first: int  # seconds of the first record

    @staticmethod
    def of(head: bytes) -> Format | None:
        if len(head) < FILE_HEADER or head[:4] not in MARKS:
            return None
        order, fraction = MARKS[head[:4]]
        (longest,) = struct.unpack_from(f"{order}I", head, 16)
        first = struct.unpack_from(f"{order}I", head, FILE_HEADER)[0] if len(head) >= FILE_HEADER + 4 else 0
        return Format(order, fraction, min(longest, LONGEST) or LONGEST, first)

    def header(self, raw: bytes) -> tuple[int, int, int, int]:
        """(seconds, fraction, bytes held, bytes sent)."""
        return struct.unpack(f"{self.order}IIII", raw)

    def plausible(self, raw: bytes) -> bool:
        seconds, part, held, sent = self.header(raw)
        return seconds >= self.first - max(SPAN, self.first // 2) and part < self.fraction and held <= self.longest and held <= sent <= 1 << 24


def next_record(stream: Stream, form: Format, place: int) -> int:
    """The first record that begins at ``place`` or later; the file's end if there is none."""
    at = FILE_HEADER if place - BACK <= FILE_HEADER else chained(stream, form, place - BACK)
    while at < place and at + RECORD_HEADER <= stream.size:
        at += RECORD_HEADER + form.header(stream.at(at, RECORD_HEADER))[2]
    return at if at + RECORD_HEADER <= stream.size else stream.size


def chained(stream: Stream, form: Format, place: int) -> int:
    """The first place from ``place`` on that begins a chain of plausible headers; the file's end if there is none."""
    while place + RECORD_HEADER <= stream.size:
        at, links = place, 0
        while links < CHAIN:
            raw = stream.at(at, RECORD_HEADER)
            if at == stream.size or (links and len(raw) < RECORD_HEADER):
                break  # the chain leads to the end
            if not form.plausible(raw):
                links = -1
                break
            length = form.header(raw)[2]
            if at + RECORD_HEADER + length > stream.size:
                links = links or -1  # a record that is cut off ends a chain, but begins none
                break
            at, links = at + RECORD_HEADER + length, links + 1
        if links > 0:
            return place
        place += 1
    return stream.size


class Range(InputPartition):
    def __init__(self, path: str, uri: str, size: int, start: int, stop: int):
        self.path, self.uri, self.size, self.start, self.stop = path, uri, size, start, stop


class Pushed:
    """Comparisons with constants that a reader takes over."""

    def __init__(self) -> None:
        self.paths: set[str] | None = None
        self.least, self.most = float("-inf"), float("inf")

    def take(self, filters: list[Filter], timed: bool) -> Iterable[Filter]:
        """Takes what it can; what is not exact (open bounds) is given back as well."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("path",):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = named if self.paths is None else self.paths & named
            elif timed and isinstance(f, GreaterThanOrEqual | GreaterThan) and f.attribute == ("seconds",):
                self.least = max(self.least, f.value)
                if isinstance(f, GreaterThan):
                    yield f
            elif timed and isinstance(f, LessThanOrEqual | LessThan) and f.attribute == ("seconds",):
                self.most = min(self.most, f.value)
                if isinstance(f, LessThan):
                    yield f
            else:
                yield f

    def path(self, path: str) -> bool:
        return self.paths is None or path in self.paths


class CaptureReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split, self.pushed = path, split, Pushed()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        yield from self.pushed.take(filters, True)

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        files = [(path, size) for path, size in listed(self.path) if self.pushed.path(path)]
        together = max(1, -(-sum(size for _, size in files) // (MOST * self.split))) if self.split else 1
        for path, size in files:
            step = self.split * together or max(size, 1)
            out += [Range(path, self.path, size, a, min(a + step, size)) for a in range(0, size, step)]
        return out or [Range("", self.path, 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.size:
            return
        store, _ = opened(part.uri)
        with store.open_input_file(part.path) as file:
            stream = Stream(file, part.size)
            form = Format.of(stream.at(0, FILE_HEADER + RECORD_HEADER))
            if form is None:
                return
            place = FILE_HEADER if part.start == 0 else next_record(stream, form, max(part.start, FILE_HEADER))
            rows: list[tuple] = []
            while place < part.stop and place + RECORD_HEADER <= part.size:
                seconds, part_of, held, _ = form.header(stream.at(place, RECORD_HEADER))
                if place + RECORD_HEADER + held > part.size:
                    place = part.size  # cut off
                    break
                at = seconds + part_of / form.fraction
                if self.pushed.least <= at <= self.pushed.most:
                    rows.append((part.path, place, at, stream.at(place + RECORD_HEADER, held)))
                place += RECORD_HEADER + held
                if len(rows) >= ROWS or sum(len(r[3]) for r in rows[-1:]) > BUFFER:
                    yield self._batch(rows)
                    rows = []
            if rows:
                yield self._batch(rows)
            if part.stop < part.size and place < part.size and next_record(stream, form, part.stop) != max(place, part.stop):
                raise RuntimeError(f"{part.path}: no sure record after byte {part.stop}; read it with split=0")

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.float64(), pa.binary()), strict=True)], names=["path", "at", "seconds", "frame"])


class Captures(DataSource):
    """(path, at: the record's place in the file, seconds, frame). Options: path, and split, the bytes of a range (64 MiB; 0: whole files); over ``MOST`` ranges are joined."""

    @classmethod
    def name(cls) -> str:
        return "silt_captures"

    def schema(self) -> str:
        return "path string, at long, seconds double, frame binary"

    def reader(self, schema: StructType) -> CaptureReader:
        return CaptureReader(self.options["path"], int(self.options.get("split", 64 << 20)))


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.pushed = path, Pushed()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        yield from self.pushed.take(filters, False)

    def partitions(self) -> list[InputPartition]:
        return [Range(p, self.path, n, 0, n) for p, n in listed(self.path) if self.pushed.path(p)] or [Range("", self.path, 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.size:
            return
        store, _ = opened(part.uri)
        with store.open_input_file(part.path) as file:
            try:
                entries = [e for e in zipfile.ZipFile(file).infolist() if not e.is_dir()]
            except (zipfile.BadZipFile, pa.ArrowInvalid):  # Arrow refuses to look before the beginning
                return
        for i in range(0, len(entries), ROWS):
            some = entries[i : i + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(some), pa.string()), pa.array([e.filename for e in some], pa.string()), pa.array([e.file_size for e in some], pa.int64())], names=["path", "entry", "size"])


class Archives(DataSource):
    """(path, entry, size) of the files in zip and jar archives; anything else has none. Option: path."""

    @classmethod
    def name(cls) -> str:
        return "silt_archives"

    def schema(self) -> str:
        return "path string, entry string, size long"

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make both formats known to ``spark.read.format``, and let filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(Captures)
    spark.dataSource.register(Archives)
