"""Lookups by distance, components kept up to date, documents and texts taken apart by generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from silt.functions import generators
from silt.operators import graph, leaves, metric
from silt.operators import similarity as sim
from silt.plans.registry import query
from silt.plans.similar import _H, _hashed, _pairs_sql
from silt.sources.tables import table


@query("pivot_names", "SELECT DISTINCT q.p_name AS query, n.p_name AS value, CAST(levenshtein(q.p_name, n.p_name) AS INTEGER) AS distance FROM part q JOIN part n ON levenshtein(q.p_name, n.p_name) <= 4 WHERE q.p_partkey % 100 = 0")
def pivot_names(spark, sf_dir):
    names = table(spark, sf_dir, "part")
    return metric.PivotIndex.of(names, "p_name", metric.edits).within(names.filter("p_partkey % 100 = 0"), "p_name", 4)


@query("pivot_hashes", f"WITH {_H} SELECT DISTINCT q.front AS query, v.front AS value, CAST(bit_count(xor(q.front, v.front)) AS INTEGER) AS distance FROM h q JOIN h v ON bit_count(xor(q.front, v.front)) <= 6 WHERE q.doc_id % 100 = 0")
def pivot_hashes(spark, sf_dir):
    hashes = _hashed(spark, sf_dir)
    return metric.PivotIndex.of(hashes, "front", metric.hamming, 8, metric.hamming_keys).within(hashes.filter("doc_id % 100 = 0"), "front", 6)


_EDGES = f"e AS ({_pairs_sql('front')}), g AS (SELECT a, b FROM e WHERE (a + b) % 7 <> 3)"  # some edges go, others come


@query(
    "updated_components",
    f"""WITH RECURSIVE {_H}, {_EDGES}, s AS (SELECT a AS n, b AS m FROM g UNION SELECT b, a FROM g), r AS (SELECT n, n AS c FROM s UNION SELECT s.n, r.c FROM s JOIN r ON s.m = r.n)
        SELECT n AS node, min(c) AS component FROM r GROUP BY 1""",
)
def updated_components(spark, sf_dir):
    """The graph loses edges with (a + b) % 7 = 3 and gains those with (a + b) % 7 = 5."""
    edges = graph._cut(sim.hamming_pairs(_hashed(spark, sf_dir), "doc_id", "front", 10).select("a", "b"))
    kind = F.pmod(F.col("a") + F.col("b"), F.lit(7))
    before = graph.components(edges.filter(kind != 5))
    return graph.updated_components(before, edges.filter(~kind.isin(3, 5)), edges.filter(kind == 3), edges.filter(kind == 5))[0]


@query(
    "json_leaves_by_level",
    """SELECT * FROM (SELECT o_orderkey, unnest(['key', 'tags.[0]', 'tags.[2].by', 'deep.a.b.c', 'on']) AS path, unnest([CAST(o_orderkey AS VARCHAR), o_orderstatus, CAST(o_custkey AS VARCHAR), o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN 'true' END]) AS value FROM orders) WHERE value IS NOT NULL""",
)
def json_leaves_by_level(spark, sf_dir):
    parts = """concat('{"key":', o_orderkey, ',"none":null,"empty":[],"on":', o_orderkey % 2 = 0, ',"deep":{"a":{"b":{"c":"', o_orderpriority, '"}}},"tags":["', o_orderstatus, '",null,{"by":', o_custkey, '}]}')"""
    docs = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(parts).alias("doc"))
    return leaves.json_leaves(docs, ["o_orderkey"], "doc")


@query("json_selected", """SELECT event_id, CASE WHEN value IS NULL THEN '{"k":' || json_extract_string(props, '$.k') || '}' ELSE '{"k":' || json_extract_string(props, '$.k') || ',"type":"' || event_type || '"}' END AS doc FROM events""")
def json_selected(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"props":'), "props", F.lit(',"kind":'), F.when(F.col("value").isNull(), "null").otherwise(F.to_json(F.struct(F.col("event_type").alias("n")))), F.lit("}")).alias("doc"))
    return e.select("event_id", leaves.selected(F.col("doc"), {"k": "$.props.k", "type": "$.kind.n", "missing": "$.none"}).alias("doc"))


@query(
    "generated_numbers",
    "SELECT o_orderkey, CAST(unnest(CASE WHEN o_orderkey % 3 = 0 THEN [0, 2] ELSE [0, 1, 2] END) AS BIGINT) AS pos, CAST(unnest(CASE WHEN o_orderkey % 3 = 0 THEN [o_custkey, o_orderkey] ELSE [o_custkey, 5, o_orderkey] END) AS DOUBLE) AS value FROM orders",
)
def generated_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("\n", F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, "none").otherwise(" 5e0 "), F.col("o_orderkey").cast("string"), F.lit("")).alias("text"))
    return rows.lateralJoin(generators.numbers_of(F.col("text").outer(), F.lit("skip"))).select("o_orderkey", "pos", "value")


@query(
    "generated_bins",
    """WITH r AS (SELECT l_returnflag, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1), b AS (SELECT *, unnest(range(0, 10)) AS bin FROM r)
       SELECT b.l_returnflag, CAST(bin AS INTEGER) AS bin, count(l_quantity) AS n FROM b LEFT JOIN lineitem l ON l.l_returnflag = b.l_returnflag AND l_quantity >= lo + (hi - lo) * bin / 10 AND (l_quantity < lo + (hi - lo) * (bin + 1) / 10 OR bin = 9) GROUP BY 1, 2""",
)
def generated_bins(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity")
    sums = rows.groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("times"))
    ranges = rows.groupBy("l_returnflag").agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    bins = ranges.lateralJoin(generators.bins_of(F.col("lo").outer(), F.col("hi").outer(), F.lit(10)))
    met = bins.join(sums, "l_returnflag").filter((F.col("l_quantity") >= F.col("low")) & ((F.col("l_quantity") < F.col("high")) | (F.col("bin") == 9)))
    found = met.groupBy("l_returnflag", "bin").agg(F.sum("times").alias("n"))
    return bins.select("l_returnflag", "bin").join(found, ["l_returnflag", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
