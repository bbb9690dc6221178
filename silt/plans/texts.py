"""Text, JSON, codec and media queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from silt.functions import text as T
from silt.plans.registry import query
from silt.sources import readers, sinks
from silt.sources.tables import table


@query("regex_filter", "SELECT doc_id, n_chars FROM documents WHERE regexp_matches(text, '(?i)licen[cs]e') AND NOT regexp_matches(text, '\\|')")
def regex_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.filter(F.col("text").rlike("(?i)licen[cs]e") & ~F.col("text").rlike(r"\|")).select("doc_id", "n_chars")


@query("word_search", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\\bthat\\b')")
def word_search(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.col("text").rlike(r"(?i)\bthat\b")).select("doc_id")


@query("exclude_patterns", "SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '(?:\\|)|(?:###)|(?:token)')")
def exclude_patterns(spark, sf_dir):
    return readers.excluded(table(spark, sf_dir, "documents"), [r"\|", "###", "token"], "text").select("doc_id")


@query("nth_column", "SELECT p_partkey, list_extract(regexp_split_to_array(trim(p_name), '\\s+'), 2) AS second, list_extract(regexp_split_to_array(trim(p_name), '\\s+'), -1) AS last FROM part")
def nth_column(spark, sf_dir):
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", T.nth(n, 1).alias("second"), T.nth(n, -1).alias("last"))


@query("extract_href", """SELECT page_id, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*"([^"]*)"', 1)) AS href FROM pages""")
def extract_href(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(T.attribute(F.col("html"), "href")).alias("href"))


_NUM = "(starts_with(t, 's') AND contains(t, 'e')) OR contains(t, 'x') OR regexp_matches(t, '^[0-9]+(\\.[0-9]+)*$')"


@query("tokens", f"SELECT doc_id, count(t) AS n, count(t) FILTER (WHERE {_NUM}) AS n_numeric, count(DISTINCT t) AS n_distinct FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS t FROM documents) WHERE t <> '' GROUP BY 1")
def tokens(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t")).filter(F.size("t") > 0)
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.filter("t", T.numeric_token)).cast("long").alias("n_numeric"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(
    "codecs",
    """SELECT p_partkey, upper(to_hex(p_partkey)) AS hex, p_partkey AS back, '"' || replace(p_name, '"', '\\"') || '"' AS quoted, p_brand AS plain, CAST(p_size AS VARCHAR) AS size FROM part""",
)
def codecs(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("hex", T.hex_of(F.col("p_partkey")))
    colour = F.concat(F.lit("\x1b[01;31m"), "p_brand", F.lit("\x1b[0m"))
    return p.select("p_partkey", "hex", T.from_hex(F.concat(F.lit("0x"), "hex")).alias("back"), T.quoted(F.col("p_name")).alias("quoted"), T.without_colours(colour).alias("plain"), T.without_point_zero(F.concat(F.col("p_size").cast("string"), F.lit(".0"))).alias("size"))


@query("html_cells", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS cell FROM pages")
def html_cells(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_escaped(F.col("html")).alias("cell"))


@query("data_uris", "SELECT p_partkey, 'data:text/plain;base64,' || base64(encode(repeat(p_name, 5))) AS uri FROM part")
def data_uris(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.data_uri("text/plain", F.encode(F.repeat("p_name", F.lit(5)), "utf-8")).alias("uri"))


@query("json_flatten", "SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_flatten(spark, sf_dir):
    e = readers.json_lines(table(spark, sf_dir, "events").select("event_id", "props"), "props")
    leaves = e.lateralJoin(spark.tvf.variant_explode(F.col("event").outer()))
    return leaves.select("event_id", F.col("key").alias("path"), F.col("value").cast("string").alias("value")).filter("value IS NOT NULL")


@query("json_route", "SELECT CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0 THEN 'even' ELSE 'odd' END AS route, count(*) AS n FROM events GROUP BY 1")
def json_route(spark, sf_dir):
    e = readers.json_lines(table(spark, sf_dir, "events"), "props")
    k = F.try_variant_get("event", "$.k", "int")
    return e.groupBy(F.when(k % 2 == 0, "even").otherwise("odd").alias("route")).agg(F.count("*").alias("n"))


@query("json_defaults", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.limit') AS BIGINT), TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 8192) AS n FROM events")
def json_defaults(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("v", F.try_parse_json("props"))
    return e.select("event_id", F.coalesce(F.try_variant_get("v", "$.limit", "long"), F.try_variant_get("v", "$.k", "long"), F.lit(8192)).alias("n"))


@query("epoch_format", "SELECT o_orderkey, strftime(o_orderdate, '%H:%M:%S-%Y/%m/%d') AS t FROM orders")
def epoch_format(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.epoch_text(F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("t"))


@query("clock_format", "SELECT o_orderkey, (s // 3600) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS t FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS s FROM orders)")
def clock_format(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.clock(F.col("o_totalprice")).alias("t"))


@query(
    "media_rates",
    """SELECT p_partkey, round(CASE WHEN w * h * fps * s > 0 THEN (8 * size - s * 128000.0) / (w * h * fps * s) ELSE -1 END, 9) AS bpp, CAST(floor(0.06 * w * h * fps / 1000) AS BIGINT) AS kbps
       FROM (SELECT p_partkey, p_size * 16.0 AS w, p_size * 9.0 AS h, 25.0 AS fps, CAST(p_partkey % 50 AS DOUBLE) AS s, p_retailprice * 100000 AS size FROM part)""",
)
def media_rates(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    w, h, fps, s, size = F.col("p_size") * 16.0, F.col("p_size") * 9.0, F.lit(25.0), (F.col("p_partkey") % 50).cast("double"), F.col("p_retailprice") * 100000
    return p.select("p_partkey", F.round(T.bits_per_pixel(size, s, F.lit(128000.0), w, h, fps), 9).alias("bpp"), T.target_kbps(w, h, fps).alias("kbps"))


@query("report_lines", "SELECT lang || '#@#' || count(DISTINCT source) || ' ' || md5(text) AS line FROM documents GROUP BY lang, md5(text), text")
def report_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("lang", F.md5("text").alias("md5")).agg(F.countDistinct("source").alias("copies"))
    return d.select(sinks.redundancy_line("lang", "copies", "md5").alias("line"))
