"""Catalogue queries over ``documents``: source = top folder, md5(text) = content digest."""

from __future__ import annotations

from pyspark.sql import functions as F

from silt.operators import catalog as op
from silt.plans.registry import query
from silt.sources.tables import table


@query(
    "redundancy",
    """SELECT md5(text) AS md5, count(DISTINCT source) AS copies
       FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) < 2""",
)
def redundancy(spark, sf_dir):
    return op.redundancy(table(spark, sf_dir, "documents"), [F.md5("text").alias("md5")], "source", 2)


@query(
    "redundancy_scoped",
    """SELECT lang, md5(text) AS md5, count(DISTINCT source) AS copies FROM documents
       WHERE source IN ('src0', 'src3', 'src5') AND text IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT source) < 2""",
)
def redundancy_scoped(spark, sf_dir):
    return op.redundancy(table(spark, sf_dir, "documents"), [F.col("lang"), F.md5("text").alias("md5")], "source", 2, ["src0", "src3", "src5"])


# The later state of the catalogue: every row is on both sides. French documents have moved (to another id), and those of
# one source have grown.
MOVED = "CASE WHEN lang = 'fr' THEN -1 - doc_id ELSE doc_id END"
GROWN = "CASE WHEN source = 'src2' THEN n_chars + 1 ELSE n_chars END"


def _old(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _new(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumns({"doc_id": F.expr(MOVED), "n_chars": F.expr(GROWN)})


OLD = "documents"
NEW = f"(SELECT * REPLACE ({MOVED} AS doc_id, {GROWN} AS n_chars) FROM documents)"


@query(
    "snapshot_diff",
    f"""SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(o.source, n.source) AS source,
        CASE WHEN o.doc_id IS NULL THEN 'INSERT' WHEN n.doc_id IS NULL THEN 'DELETE' WHEN o.n_chars <> n.n_chars THEN 'UPDATE' ELSE 'SAME' END AS status
        FROM {OLD} o FULL JOIN {NEW} n ON o.doc_id = n.doc_id AND o.source = n.source""",
)
def snapshot_diff(spark, sf_dir):
    return op.snapshot_diff(_old(spark, sf_dir), _new(spark, sf_dir), ["doc_id", "source"], ["n_chars"])


@query(
    "diff_counts",
    f"""SELECT CASE WHEN o.doc_id IS NULL THEN 'INSERT' WHEN n.doc_id IS NULL THEN 'DELETE' WHEN o.n_chars <> n.n_chars THEN 'UPDATE' ELSE 'SAME' END AS status, count(*) AS n
        FROM {OLD} o FULL JOIN {NEW} n ON o.doc_id = n.doc_id GROUP BY 1""",
)
def diff_counts(spark, sf_dir):
    return op.snapshot_diff(_old(spark, sf_dir), _new(spark, sf_dir), ["doc_id"], ["n_chars"]).groupBy("status").agg(F.count("*").alias("n"))


PATH = "concat(source, '/d', CAST(doc_id % 5 AS string), '/', CAST(doc_id AS string))"


@query(
    "protected_delete",
    f"""WITH o AS (SELECT source || '/d' || (doc_id % 5) || '/' || doc_id AS path FROM {OLD}), n AS (SELECT source || '/d' || (doc_id % 5) || '/' || doc_id AS path FROM {NEW})
        SELECT path FROM o WHERE path NOT IN (SELECT path FROM n) AND NOT (path = 'src3' OR starts_with(path, 'src3/')) AND NOT (path = 'src0/d1' OR starts_with(path, 'src0/d1/'))""",
)
def protected_delete(spark, sf_dir):
    paths = lambda d: d.select(F.expr(PATH).alias("path"))
    return op.protected_deletes(paths(_old(spark, sf_dir)), paths(_new(spark, sf_dir)), "path", ["src3", "src0/d1"])


# Documents of one source could not be read; others have changed.
DIGEST = "CASE WHEN source = 'src4' THEN NULL ELSE md5(text) END"
FOUND = "CASE WHEN source = 'src4' THEN NULL WHEN source = 'src5' THEN md5(lang) ELSE md5(text) END"


@query(
    "integrity_classify",
    f"""SELECT coalesce(k.doc_id, f.doc_id) AS doc_id, CASE WHEN k.doc_id IS NULL THEN 'NEW' WHEN f.doc_id IS NULL THEN 'MISSING' WHEN k.d IS NOT DISTINCT FROM f.d THEN 'MATCH' ELSE 'MISMATCH' END AS status
        FROM (SELECT doc_id, {DIGEST} AS d FROM {OLD}) k FULL JOIN (SELECT doc_id, {FOUND} AS d FROM {NEW}) f ON k.doc_id = f.doc_id""",
)
def integrity_classify(spark, sf_dir):
    known = _old(spark, sf_dir).select("doc_id", F.expr(DIGEST).alias("d"))
    return op.integrity(known, _new(spark, sf_dir).select("doc_id", F.expr(FOUND).alias("d")), ["doc_id"], "d")


@query(
    "needed_work",
    """SELECT doc_id, 'known' AS side FROM documents SEMI JOIN labels USING (doc_id) UNION ALL SELECT doc_id, 'todo' AS side FROM documents ANTI JOIN labels USING (doc_id)""",
)
def needed_work(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return docs.join(labels, "doc_id", "left_semi").withColumn("side", F.lit("known")).union(op.deleted(docs, labels, ["doc_id"]).withColumn("side", F.lit("todo")))


@query(
    "content_join",
    """SELECT n.doc_id AS new_id, o.old_id, n.n_chars, md5(n.text) AS md5 FROM documents n
       JOIN (SELECT min(doc_id) AS old_id, n_chars, md5(text) AS m FROM documents GROUP BY ALL) o ON o.n_chars = n.n_chars AND o.m = md5(n.text)""",
)
def content_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.md5("text").alias("md5"))
    return op.content_join(docs.withColumnRenamed("doc_id", "new_id"), docs.withColumnRenamed("doc_id", "old_id"), ["n_chars", "md5"], "new_id", "old_id")


# The later snapshot: urgent orders have another key, open ones have grown.
_ORDER = "CASE WHEN o_orderpriority = '1-URGENT' THEN -1 - o_orderkey ELSE o_orderkey END"
_MORE = "CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END"
_GROWTH = f"""SELECT n.o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN '[N]' ELSE '[C]' END AS mark, n.size - coalesce(b.size, 0) AS delta
       FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) + {_MORE} AS size FROM (SELECT * REPLACE ({_ORDER} AS o_orderkey) FROM orders)) n
       LEFT JOIN (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders) b ON n.o_orderkey = b.o_orderkey WHERE b.o_orderkey IS NULL OR n.size <> b.size"""


@query("snapshot_growth", _GROWTH)
def snapshot_growth(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    now = orders.select(F.expr(_ORDER).alias("o_orderkey"), F.expr(f"floor(o_totalprice) + {_MORE}").alias("size"))
    return op.growth(orders.select("o_orderkey", F.floor("o_totalprice").alias("size")), now, "o_orderkey", "size")


@query("growth_totals", f"SELECT mark, count(*) AS n, CAST(sum(delta) AS BIGINT) AS total FROM ({_GROWTH}) GROUP BY mark")
def growth_totals(spark, sf_dir):
    return snapshot_growth(spark, sf_dir).groupBy("mark").agg(F.count("*").alias("n"), F.sum("delta").alias("total"))


@query(
    "upsert",
    """SELECT coalesce(u.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN u.p_partkey IS NULL THEN b.p_name ELSE u.p_name END AS p_name, CASE WHEN u.p_partkey IS NULL THEN b.p_size ELSE u.p_size END AS p_size
       FROM part b FULL JOIN (SELECT CASE WHEN p_type = 'SMALL' THEN -1 - p_partkey ELSE p_partkey END AS p_partkey, upper(p_name) AS p_name, p_size + 1 AS p_size FROM part) u ON b.p_partkey = u.p_partkey""",
)
def upsert(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_type")
    key = F.expr("CASE WHEN p_type = 'SMALL' THEN -1 - p_partkey ELSE p_partkey END").alias("p_partkey")
    return op.upsert(part.drop("p_type"), part.select(key, F.upper("p_name").alias("p_name"), (F.col("p_size") + 1).alias("p_size")), ["p_partkey"])


@query("pruned_root", "SELECT doc_id, source FROM documents WHERE source IS DISTINCT FROM 'src1' OR doc_id IN (SELECT doc_id FROM labels)")
def pruned_root(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"))
    return op.pruned(docs, docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi"), "path", "src1").select("doc_id", "source")


@query("same_place_duplicates", "SELECT CAST(doc_id AS VARCHAR) AS path FROM documents WHERE source IS DISTINCT FROM 'src2' AND text IS NOT NULL AND n_chars IS NOT NULL")
def same_place_duplicates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "source", "n_chars", F.md5("text").alias("md5"))
    b = docs.withColumn("n_chars", F.expr(GROWN))
    return op.same_place_duplicates(docs, b, "path", ["n_chars", "md5"])


@query("set_subtract", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_subtract(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("set_union", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("ordered_distinct", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def ordered_distinct(spark, sf_dir):
    return op.first_per_key(table(spark, sf_dir, "events"), ["event_type"], [F.col("ts"), F.col("event_id")]).select("event_type", "event_id")


@query("catalog_view_md5", "SELECT doc_id, md5(text) AS md5, md5(substr(text, 1, 100)) AS head_md5 FROM documents")
def catalog_view_md5(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.md5(F.substring("text", 1, 100)).alias("head_md5"))


@query("dir_sizes", "SELECT source, sum(n_chars)::BIGINT AS bytes, sum(n_chars)::BIGINT // 1024 AS kb FROM documents GROUP BY ROLLUP (source)")
def dir_sizes(spark, sf_dir):
    return table(spark, sf_dir, "documents").rollup("source").agg(F.sum("n_chars").alias("bytes"), F.expr("sum(n_chars) div 1024").alias("kb"))


@query("lookup_enrich", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def lookup_enrich(spark, sf_dir):
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("s_suppkey", "n_name", "r_name")
