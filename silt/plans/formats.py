"""Queries over codes, names, report lines and small readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from silt.functions import text as T
from silt.operators import catalog
from silt.plans.registry import query
from silt.sources import readers, sinks
from silt.sources.tables import table


@query("deleted_rows", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def deleted_rows(spark, sf_dir):
    return catalog.deleted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter("toxic = 1"), ["doc_id"]).select("doc_id")


@query(
    "report_formats",
    """SELECT p_partkey, p_name || '###' || p_type AS existing, p_type || '####' || p_name || '####' || p_size || ':' || p_partkey AS similar,
       'mv -i -- ''' || p_name || '''\\''''s'' ''' || p_type || '''' AS renamed FROM part""",
)
def report_formats(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("quoted", F.concat("p_name", F.lit("'s")))
    return p.select("p_partkey", sinks.existing_line("p_name", "p_type").alias("existing"), sinks.similar_line("p_name", "p_type", "p_partkey", "p_size").alias("similar"), sinks.rename_line("quoted", "p_type").alias("renamed"))


@query("same_size_and_time", "SELECT doc_id FROM documents WHERE doc_id % 4 <> 1 AND n_chars IS NOT NULL")
def same_size_and_time(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.lit(0).alias("time"))
    return catalog.same_place_duplicates(a, a.withColumn("time", F.when(F.col("doc_id") % 4 == 1, 1).otherwise(0)), "doc_id", ["n_chars", "time"])


@query("within_tolerance", "SELECT doc_id, doc_id % 3 >= 2 OR doc_id % 5 = 0 AS changed FROM documents")
def within_tolerance(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 > 0, F.lit(10.0)).alias("a"), (F.lit(10.0) + F.col("doc_id") % 3).alias("b"))
    return d.select("doc_id", catalog.changed(F.col("a"), F.col("b"), 2.0).alias("changed"))


@query("file_stems", "SELECT p_partkey, replace(lower(p_name), ' ', '.') AS stem, CASE WHEN length(p_type) > 6 THEN '...' || substr(p_type, length(p_type) - 2) ELSE p_type END AS short FROM part")
def file_stems(spark, sf_dir):
    name = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit(".")), F.lit(".TXT"))
    return table(spark, sf_dir, "part").select("p_partkey", T.stem(name).alias("stem"), T.shortened(F.col("p_type"), 6).alias("short"))


@query("decoded_names", "SELECT p_partkey, p_name AS url, 'Ä' || p_name AS unicode, 'A' || p_name AS hex, '<' || p_name || '&é' AS html, p_name || ' ü' AS mime FROM part")
def decoded_names(spark, sf_dir):
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", T.url_decoded(F.replace(n, F.lit(" "), F.lit("%20"))).alias("url"), T.unicode_unescaped(F.concat(F.lit("\\u00c4"), n)).alias("unicode"),
        T.hex_unescaped(F.concat(F.lit("\\x41"), n)).alias("hex"), T.html_unescaped(F.concat(F.lit("&lt;"), n, F.lit("&amp;&eacute;"))).alias("html"),
        T.mime_decoded(F.concat(F.lit("=?utf-8?q?"), F.replace(n, F.lit(" "), F.lit("_")), F.lit("_=C3=BC?="))).alias("mime"),
    )


@query(
    "compact_numbers",
    """SELECT o_orderkey, CASE WHEN o_orderkey < 1440 THEN (o_orderkey // 60) || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') WHEN o_orderkey < 10080 THEN (o_orderkey // 1440) || 'd' ELSE (o_orderkey // 10080) || 'w' END AS age,
       CASE WHEN v >= 1073741824 THEN (v // 1073741824) || 'G' WHEN v >= 1048576 THEN (v // 1048576) || 'M' WHEN v >= 1024 THEN (v // 1024) || 'k' ELSE CAST(v AS VARCHAR) END AS scaled FROM (SELECT o_orderkey, o_orderkey * o_orderkey AS v FROM orders)""",
)
def compact_numbers(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.compact_minutes(k).alias("age"), T.scaled(k * k).alias("scaled"))


@query("agent_events", "SELECT event_id, event_type AS kind, CASE WHEN event_id % 2 = 0 THEN 'text_delta' ELSE 'bash' END AS detail, CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) END AS delta FROM events WHERE event_type <> 'error'")
def agent_events(spark, sf_dir):
    inner = F.when(F.col("event_id") % 2 == 0, F.format_string('"assistantMessageEvent": {"type": "text_delta", "delta": "%d"}', "event_id")).otherwise(F.lit('"toolName": "bash"'))
    kind = F.when(F.col("event_type") == "error", "turn_end").otherwise(F.col("event_type"))
    lines = table(spark, sf_dir, "events").select("event_id", F.explode(F.array(F.concat(F.lit('{"type": "'), kind, F.lit('", '), inner, F.lit("}")), F.lit("{broken"))).alias("line"))
    return readers.routed_events(lines)


def _number_lines(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("pos"), F.when(F.col("p_partkey") % 50 == 49, "bad").otherwise(F.col("p_size").cast("string")).alias("line"))


@query("numbers_skip", "SELECT p_partkey AS pos, CAST(p_size AS DOUBLE) AS value FROM part WHERE p_partkey % 50 <> 49")
def numbers_skip(spark, sf_dir):
    return readers.numbers(_number_lines(spark, sf_dir), "skip")


@query("numbers_zero", "SELECT p_partkey AS pos, CASE WHEN p_partkey % 50 = 49 THEN 0.0 ELSE CAST(p_size AS DOUBLE) END AS value FROM part")
def numbers_zero(spark, sf_dir):
    return readers.numbers(_number_lines(spark, sf_dir), "zero")


@query("numbers_stop", "SELECT p_partkey AS pos, CAST(p_size AS DOUBLE) AS value FROM part WHERE p_partkey < 49")
def numbers_stop(spark, sf_dir):
    return readers.numbers(_number_lines(spark, sf_dir), "stop")


@query("weighted_lines", "SELECT CAST(p_size AS DECIMAL(38, 18)) AS value, p_partkey AS count FROM part WHERE p_partkey % 50 <> 49")
def weighted_lines(spark, sf_dir):
    count = F.when(F.col("p_partkey") % 50 == 49, "x").otherwise(F.col("p_partkey").cast("string"))
    return readers.weighted_points(table(spark, sf_dir, "part").select(F.concat_ws(" ", count, F.col("p_size").cast("string")).alias("line")), value_first=False)


@query(
    "allowed_hosts",
    """SELECT CASE p_partkey % 4 WHEN 0 THEN 'v4' WHEN 1 THEN 'cidr' WHEN 2 THEN 'v6' ELSE 'host' END AS kind, CASE p_partkey % 4 WHEN 0 THEN '10.0.0.' || p_size WHEN 1 THEN '10.' || p_size || '.0.0/16' WHEN 2 THEN 'fe80::' || p_size ELSE 'h' || p_size || '.example' END AS host,
       CASE WHEN p_partkey % 4 IN (2, 3) THEN CAST(8000 + p_size AS INTEGER) END AS port FROM part""",
)
def allowed_hosts(spark, sf_dir):
    s, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    port = (F.col("p_size") + 8000).cast("string")
    line = F.when(k == 0, F.concat(F.lit("10.0.0."), s)).when(k == 1, F.concat(F.lit("10."), s, F.lit(".0.0/16"))).when(k == 2, F.concat(F.lit("[fe80::"), s, F.lit("]:"), port)).otherwise(F.concat(F.lit("h"), s, F.lit(".example:"), port))
    return readers.allow_list(table(spark, sf_dir, "part").select(F.explode(F.array(line, F.lit("# no address"))).alias("line")))


@query("canonical_xml", """SELECT p_partkey, '<a x="1" y="' || p_size || '">' || chr(10) || '   <b>' || p_brand || '</b>' || chr(10) || '   <c></c>' || chr(10) || '</a>' AS xml FROM part""")
def canonical_xml(spark, sf_dir):
    doc = F.concat(F.lit('<a y="'), F.col("p_size").cast("string"), F.lit('" x="1"> <c/>\n<b>'), "p_brand", F.lit("</b></a>"))
    return table(spark, sf_dir, "part").select("p_partkey", T.sorted_xml(doc).alias("xml"))
