"""Queries over what earlier steps of them have written: versioned catalogues, captures, logs, lists and trees of files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from silt.operators import shared
from silt.plans.registry import query
from silt.sources import captures, committed, readers, sinks, walk
from silt.sources.tables import table
from silt.sources.versions import Catalogue


def _folder(spark, kind: str) -> str:
    return f"{shared.root(spark)}/{kind}/{uuid.uuid4().hex}"


def _catalogue(spark, sf_dir) -> Catalogue:
    """All orders; those of clerks that end in 7 are put in again with another status, some with new keys; then those with key % 5 = 0 go."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    cat = Catalogue(spark, _folder(spark, "catalogues"), ["o_orderkey"], 16)
    cat.replace(orders)
    again = orders.filter("o_orderkey % 7 = 3")
    cat.upsert(again.withColumn("o_orderstatus", F.lit("N")).unionByName(again.withColumns({"o_orderkey": -F.col("o_orderkey"), "o_orderstatus": F.lit("A")})))
    cat.delete(orders.filter("o_orderkey % 5 = 0").select("o_orderkey"))
    return cat


_ORDERS = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"
_PUT = """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 3 THEN 'N' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders
          UNION ALL SELECT -o_orderkey, 'A', o_totalprice FROM orders WHERE o_orderkey % 7 = 3"""


@query("versioned_rows", f"SELECT * FROM ({_PUT}) WHERE NOT (o_orderkey >= 0 AND o_orderkey % 5 = 0)")
def versioned_rows(spark, sf_dir):
    return _catalogue(spark, sf_dir).read()


@query("versioned_earlier", f"SELECT 1 AS version, * FROM ({_ORDERS}) UNION ALL SELECT 2, * FROM ({_PUT})")
def versioned_earlier(spark, sf_dir):
    cat = _catalogue(spark, sf_dir)
    one, two = (cat.read(v).select(F.lit(v).alias("version"), "*") for v in (1, 2))
    return one.unionByName(two)


@query(
    "versioned_history",
    f"""SELECT 1 AS version, 'replace' AS operation, (SELECT count(*) FROM orders) AS rows UNION ALL SELECT 2, 'upsert', (SELECT count(*) FROM ({_PUT}))
        UNION ALL SELECT 3, 'delete', (SELECT count(*) FROM ({_PUT}) WHERE NOT (o_orderkey >= 0 AND o_orderkey % 5 = 0))""",
)
def versioned_history(spark, sf_dir):
    return _catalogue(spark, sf_dir).history().drop("buckets")


def _local(path: str) -> str:
    """A path as Arrow and the machine's own calls take it."""
    return path.removeprefix("file://") if path.startswith("file:///") else path


def _little(column: str) -> str:
    """SQL for four bytes of a whole number, the least first."""
    h = f"lpad(hex({column}), 8, '0')"
    return f"unhex(concat(substr({h}, 7, 2), substr({h}, 5, 2), substr({h}, 3, 2), substr({h}, 1, 2)))"


@query("capture_frames", "SELECT p_brand, CAST(1700000000 + p_partkey AS DOUBLE) AS seconds, md5(p_name || p_type) AS md5 FROM part")
def capture_frames(spark, sf_dir):
    """A capture file for each brand, written all or none, and read back in ranges of 4 KiB."""
    at = _local(_folder(spark, "captures"))
    parts = table(spark, sf_dir, "part").select("p_brand", F.expr("CAST(1700000000 + p_partkey AS bigint)").alias("s"), F.encode(F.concat("p_name", "p_type"), "utf-8").alias("f"))
    record = F.expr(f"concat({_little('s')}, {_little('0')}, {_little('octet_length(f)')}, {_little('octet_length(f)')}, f)")
    head = F.expr("unhex('D4C3B2A1020004000000000000000000FFFF000001000000')")
    whole = parts.groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("s", record.alias("r")))).alias("rs")).select(F.concat("p_brand", F.lit(".pcap")).alias("name"), F.concat(head, F.expr("unhex(array_join(transform(rs.r, x -> hex(x)), ''))")).alias("content"))
    committed.write_files(whole, at, "name", "content")
    captures.register(spark)
    got = spark.read.format("silt_captures").option("path", at).option("split", 4096).load()
    return got.select(F.regexp_extract("path", "([^/]*)\\.pcap$", 1).alias("p_brand"), "seconds", F.md5("frame").alias("md5"))


@query("merged_logs", "SELECT event_type AS stream, CAST(event_id AS VARCHAR) AS line, true AS in_order FROM events WHERE event_type IS NOT NULL UNION ALL SELECT 'merged', CAST(event_id AS VARCHAR), true FROM events WHERE event_type IS NOT NULL")
def merged_logs(spark, sf_dir):
    """Events as a log for each type beside the log of all; each line is checked against the time of the line before it in its file."""
    at = _local(_folder(spark, "logs"))
    events = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    committed.write_logs(events, at, "event_type", "at", F.concat_ws(" ", F.lpad(F.col("at").cast("string"), 20, "0"), F.col("event_id").cast("string")), parts=6)
    read = spark.read.option("pathGlobFilter", "*.log").option("recursiveFileLookup", True).option("wholetext", True).text(at)
    lines = read.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("stream"), F.split(F.rtrim("value", F.lit("\n")), "\n").alias("ls"))
    each = lines.select("stream", F.posexplode("ls").alias("i", "l"), "ls")
    return each.select("stream", F.split("l", " ")[1].alias("line"), F.expr("i = 0 OR ls[greatest(i - 1, 0)] <= l").alias("in_order"))


@query("csv_round_trip", """SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, 'a;"' || p_name || '"' AS name, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END AS p_type FROM part""")
def csv_round_trip(spark, sf_dir):
    at = _folder(spark, "csv")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit('a;"'), "p_name", F.lit('"')).alias("name"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")).alias("p_type"))
    sinks.semicolon_csv(parts, at)
    return readers.csv_strings(spark, at, ";").withColumn("name", F.replace("name", F.lit('\\"'), F.lit('"')))


@query("nul_list", "SELECT 'src' || chr(10) || p_name || ' ' || p_partkey AS path FROM part")
def nul_list(spark, sf_dir):
    at = _folder(spark, "nul")
    sinks.lines(table(spark, sf_dir, "part"), at, F.concat(F.lit("src\n"), "p_name", F.lit(" "), F.col("p_partkey").cast("string")), "\0")
    return spark.read.option("lineSep", "\0").text(at).select(F.col("value").alias("path"))


@query("walked_files", "SELECT 'd' || (doc_id % 7) || '/' || source || '/' || doc_id || '.txt' AS path, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents WHERE text IS NOT NULL")
def walked_files(spark, sf_dir):
    """Documents as files of a tree, found again by the walk."""
    at = _local(_folder(spark, "tree"))
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    name = F.concat(F.lit("d"), (F.col("doc_id") % 7).cast("string"), F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    committed.write_files(docs.select(name.alias("name"), F.encode("text", "utf-8").alias("content")), at, "name", "content")
    found, _ = walk.walk(spark, at)
    return found.select(F.expr(f"substr(path, {len(at) + 2})").alias("path"), "size")


@query(
    "caption_files",
    """SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS pos, '00:' || lpad(CAST(turn % 60 AS VARCHAR), 2, '0') || ':00.000' AS start, 'turn ' || turn || ' & ' || role AS text FROM conversations""",
)
def caption_files(spark, sf_dir):
    """Conversations as caption files with headers, tags and escapes, read back as cues."""
    at = _local(_folder(spark, "captions"))
    clock = F.concat(F.lit("00:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit(":00.000"))
    cue = F.concat(clock, F.lit(" --> 00:59:59.000 align:start\n<c.x>turn</c> <00:00:01.000>"), F.col("turn").cast("string"), F.lit(" &amp; "), "role", F.lit("\n"))
    whole = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", cue.alias("c")))), lambda x: x["c"]), "\n").alias("cues"))
    text = F.concat(F.lit("WEBVTT\nKind: captions\n\n"), "cues")
    committed.write_files(whole.select(F.concat(F.col("conv_id").cast("string"), F.lit(".vtt")).alias("name"), F.encode(text, "utf-8").alias("content")), at, "name", "content")
    got = readers.captions(spark, at)
    return got.select(F.regexp_extract("path", "([0-9]+)\\.vtt$", 1).cast("long").alias("conv_id"), "pos", "start", "text")


def _lengths(path: str):
    """(line, chars) of a text file; odd ids are refused."""
    if int(path.rpartition("/")[2].removesuffix(".txt")) % 2:
        raise ValueError("odd")
    with open(path, encoding="utf-8", newline="") as f:
        for k, line in enumerate(f.read().split("\n")):
            yield k, len(line)


@query(
    "visited_files",
    """SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS line, CAST(length(unnest(l)) AS BIGINT) AS chars, NULL AS error FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0)
       UNION ALL SELECT doc_id, NULL, NULL, 'ValueError: odd' FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 1""",
)
def visited_files(spark, sf_dir):
    """A visitor over documents as files: it counts, and its errors are rows too."""
    at = _local(_folder(spark, "visited"))
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    committed.write_files(docs.select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.encode("text", "utf-8").alias("content")), at, "name", "content")
    found, failed = walk.visited(spark, at, _lengths, "line int, chars long")
    key = F.regexp_extract("path", "([0-9]+)\\.txt$", 1).cast("long").alias("doc_id")
    return found.select(key, "line", "chars", F.lit(None).cast("string").alias("error")).unionByName(failed.select(key, F.lit(None).cast("int").alias("line"), F.lit(None).cast("long").alias("chars"), "error"))
