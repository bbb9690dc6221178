"""Text sources with a named policy for bad lines, and scans of folders."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silt.functions import text as T


def numbers(lines: DataFrame, policy: str, pos: str = "pos", line: str = "line") -> DataFrame:
    """(pos, value) of a number a line. policy: "raise", "skip", "zero", or "stop" (at the first bad line)."""
    t = F.trim(line)
    value = t.cast("double") if policy == "raise" else t.try_cast("double")
    rows = lines.select(pos, value.alias("value"))
    if policy == "zero":
        return rows.withColumn("value", F.coalesce("value", F.lit(0.0)))
    if policy == "stop":
        end = rows.filter("value IS NULL").agg(F.min(pos).alias("_end"))  # one row
        return rows.join(F.broadcast(end), F.col("_end").isNull() | (F.col(pos) < F.col("_end"))).drop("_end")
    return rows.filter("value IS NOT NULL")


def weighted_points(lines: DataFrame, value_first: bool = True, line: str = "line") -> DataFrame:
    """(value, count) of two-column lines: "value count", or "count value" split at the last blank; bad lines are skipped."""
    a, b = F.regexp_extract(F.trim(line), r"^(\S+)\s+(.*)$", 1), F.regexp_extract(F.trim(line), r"^(\S+)\s+(.*)$", 2)
    v, c = (a, b) if value_first else (b, a)
    return lines.select(v.try_cast("decimal(38,18)").alias("value"), c.try_cast("long").alias("count")).filter("value IS NOT NULL AND count IS NOT NULL")


def csv_strings(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Delimited text with a header row, every field a string, ISO-8859-1."""
    return spark.read.option("header", True).option("sep", sep).option("encoding", "ISO-8859-1").csv(path)


def json_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """``event`` as a variant; lines that are no JSON are skipped."""
    return lines.withColumn("event", F.try_parse_json(line)).filter("event IS NOT NULL")


def routed_events(lines: DataFrame, line: str = "line") -> DataFrame:
    """Agent events by kind: (kind, detail, text), without life-cycle noise."""
    e = json_lines(lines, line)
    get = lambda path: F.try_variant_get("event", path, "string")
    kind = get("$.type")
    detail = F.coalesce(get("$.assistantMessageEvent.type"), get("$.toolName"))
    return e.select(*[c for c in lines.columns if c != line], kind.alias("kind"), detail.alias("detail"), get("$.assistantMessageEvent.delta").alias("delta")).filter(~F.col("kind").isin("turn_start", "turn_end", "agent_start", "agent_end"))


def captions(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, start, text) of WebVTT files: the header ends at the first blank line; tags are stripped."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"^[\s\S]*?\n\s*\n", "").alias("body"))
    cues = whole.select("path", F.posexplode(F.regexp_extract_all("body", F.lit(r"(\d\d:\d\d:\d\d\.\d{3}) --> [^\n]*\n([\s\S]*?)(?=\n\s*\n|\s*$)"), F.lit(0))).alias("pos", "cue"))
    text = F.regexp_replace(F.regexp_replace("cue", r"^[^\n]*\n", ""), r"<[^>]*>", "")
    return cues.select("path", F.col("pos").cast("long").alias("pos"), F.left("cue", F.lit(12)).alias("start"), T.html_unescaped(F.trim(text)).alias("text"))


def files(spark: SparkSession, path: str, extensions: Sequence[str] = (), least: int = 0, without: Sequence[str] = ()) -> DataFrame:
    """(path, size, modified) below a folder; contents are not read. Filters: extensions in any case, size, path parts."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    if extensions:
        found = found.filter(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin([e.lower() for e in extensions]))
    for part in without:
        found = found.filter(~F.col("path").contains(part))
    return found.filter(F.col("size") >= least)


def digests(spark: SparkSession, path: str, prefix: int | None = None) -> DataFrame:
    """(path, md5) of whole files, or of their first bytes."""
    content = F.col("content") if prefix is None else F.expr(f"substring(content, 1, {prefix})")
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.md5(content).alias("md5"))


def allow_list(lines: DataFrame, line: str = "line") -> DataFrame:
    """(kind, host, port) of each line that is an address; comments and the rest are skipped."""
    return lines.select(T.address(F.col(line)).alias("a")).filter("a.kind IS NOT NULL").select("a.*")


def excluded(lines: DataFrame, patterns: Sequence[str], line: str = "line") -> DataFrame:
    """Lines that match none of the patterns."""
    return lines.filter(~F.col(line).rlike("|".join(f"(?:{p})" for p in patterns))) if patterns else lines


def _blobs(spark: SparkSession, path: str, read, fields: str) -> DataFrame:
    """What ``read`` yields from the bytes of each file, behind the file's path; one file is handled at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = read(content.as_py() or b"")
                size = len(next(iter(rows.values())))
                yield pa.RecordBatch.from_pydict({"path": [name.as_py()] * size, **rows})

    whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return whole.mapInArrow(run, f"path string, {fields}")


def frames(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, frame) of packet captures in the classic format, of either byte order; a cut-off last record is left out."""

    def read(content: bytes) -> dict[str, pa.Array]:
        order = {b"\xa1\xb2\xc3\xd4": ">", b"\xd4\xc3\xb2\xa1": "<", b"\xa1\xb2\x3c\x4d": ">", b"\x4d\x3c\xb2\xa1": "<"}.get(content[:4])
        found, at = [], 24
        while order and at + 16 <= len(content):
            (size,) = struct.unpack_from(f"{order}I", content, at + 8)
            if at + 16 + size > len(content):
                break
            found.append(content[at + 16 : at + 16 + size])
            at += 16 + size
        return {"pos": pa.array(range(len(found)), pa.int64()), "frame": pa.array(found, pa.binary())}

    return _blobs(spark, path, read, "pos long, frame binary")


def archive_entries(spark: SparkSession, path: str) -> DataFrame:
    """(path, entry, size) of the files in zip and jar archives; anything else has none."""

    def read(content: bytes) -> dict[str, pa.Array]:
        try:
            entries = [e for e in zipfile.ZipFile(io.BytesIO(content)).infolist() if not e.is_dir()]
        except zipfile.BadZipFile:
            entries = []
        return {"entry": pa.array([e.filename for e in entries], pa.string()), "size": pa.array([e.file_size for e in entries], pa.int64())}

    return _blobs(spark, path, read, "entry string, size long")


def xml_elements(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, depth, parent, tag, attributes, text) of the elements of XML files in document order; blank text is null, a broken file has the elements up to its fault."""
    kinds = {"pos": pa.int64(), "depth": pa.int32(), "parent": pa.int64(), "tag": pa.string(), "attributes": pa.map_(pa.string(), pa.string()), "text": pa.string()}

    def read(content: bytes) -> dict[str, pa.Array]:
        from xml.etree import ElementTree

        rows: list[list] = []
        open_: list[int] = []
        try:
            for event, e in ElementTree.iterparse(io.BytesIO(content), events=("start", "end")):
                if event == "start":
                    rows.append([len(rows), len(open_), open_[-1] if open_ else None, e.tag, sorted(e.items()), None])
                    open_.append(len(rows) - 1)
                else:
                    text = "".join(t for t in [e.text, *[c.tail for c in e]] if t and t.strip())
                    rows[open_.pop()][5] = text or None
        except ElementTree.ParseError:
            pass
        return {k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(kinds.items())}

    return _blobs(spark, path, read, "pos long, depth int, parent long, tag string, attributes map<string,string>, text string")


def workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, col, value) of the filled cells of spreadsheets in the zipped XML format; whole numbers lose their ".0"."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    kinds = {"sheet": pa.string(), "row": pa.int32(), "col": pa.int32(), "value": pa.string()}

    def read(content: bytes) -> dict[str, pa.Array]:
        from xml.etree import ElementTree

        rows = []
        try:
            book = zipfile.ZipFile(io.BytesIO(content))
            names = set(book.namelist())
            tree = lambda name: ElementTree.fromstring(book.read(name))
            texts = ["".join(t.text or "" for t in s.iter(f"{main}t")) for s in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
            places = {r.get("Id"): r.get("Target") for r in tree("xl/_rels/workbook.xml.rels")}
            for sheet in tree("xl/workbook.xml").iter(f"{main}sheet"):
                for c in tree("xl/" + places[sheet.get(rel)].removeprefix("/xl/")).iter(f"{main}c"):
                    letters = "".join(x for x in c.get("r") if x.isalpha())
                    col = 0
                    for x in letters:
                        col = col * 26 + ord(x) - 64
                    v = c.findtext(f"{main}v") if c.get("t") != "inlineStr" else "".join(t.text or "" for t in c.iter(f"{main}t"))
                    if v is not None:
                        v = texts[int(v)] if c.get("t") == "s" else v
                        rows.append((sheet.get("name"), int(c.get("r")[len(letters) :]), col, v.removesuffix(".0")))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            rows = []
        return {k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(kinds.items())}

    return _blobs(spark, path, read, "sheet string, row int, col int, value string")
