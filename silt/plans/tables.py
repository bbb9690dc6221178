"""Queries whose filters are tables (folders, roots, patterns), and aggregates of a caller's own."""

from __future__ import annotations

from pyspark.sql import functions as F

from silt.operators import aggregates, catalog, prefixes, ranks
from silt.plans.registry import query
from silt.sources.tables import table

_PATH = "concat(source, '/', lang, '/d', CAST(doc_id % 97 AS string), '/', CAST(doc_id AS string))"
_PATH_SQL = "source || '/' || lang || '/d' || (doc_id % 97) || '/' || doc_id"
#: Folders that could not be read: those of documents marked toxic, at three depths; some lie in others.
_FAILED = "CASE WHEN l.doc_id % 3 = 0 THEN concat(source, '/', lang, '/d', CAST(l.doc_id % 97 AS string)) WHEN l.doc_id % 3 = 1 THEN concat(source, '/', lang, '/d', CAST(l.doc_id % 97 AS string), '/') ELSE concat(source, '/', lang, '/d', CAST(l.doc_id % 97 AS string), '/', CAST(l.doc_id AS string)) END"
_FAILED_SQL = f"SELECT DISTINCT CASE WHEN l.doc_id % 3 = 2 THEN {_PATH_SQL.replace('doc_id', 'l.doc_id')} ELSE source || '/' || lang || '/d' || (l.doc_id % 97) END AS folder FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE toxic = 1"
_BELOW_SQL = "EXISTS (SELECT 1 FROM f WHERE p.path = f.folder OR starts_with(p.path, f.folder || '/'))"


def _paths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_PATH).alias("path"))


def _failed(spark, sf_dir):
    marks = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").alias("l")
    return marks.join(table(spark, sf_dir, "documents").alias("d"), F.expr("l.doc_id = d.doc_id")).select(F.expr(_FAILED).alias("folder"))


@query("protected_by_table", f"WITH p AS (SELECT {_PATH_SQL} AS path FROM documents WHERE doc_id % 2 = 0), f AS ({_FAILED_SQL}) SELECT path FROM p WHERE NOT {_BELOW_SQL}")
def protected_by_table(spark, sf_dir):
    old = _paths(spark, sf_dir)
    return catalog.protected_deletes(old, old.filter("doc_id % 2 = 1"), "path", _failed(spark, sf_dir))


@query("below_folders", f"WITH p AS (SELECT doc_id, {_PATH_SQL} AS path FROM documents), f AS ({_FAILED_SQL}) SELECT doc_id, {_BELOW_SQL} AS below FROM p")
def below_folders(spark, sf_dir):
    return prefixes.marked_below(_paths(spark, sf_dir), "path", _failed(spark, sf_dir)).select("doc_id", "below")


@query(
    "pruned_roots",
    f"WITH p AS (SELECT doc_id, {_PATH_SQL} AS path FROM documents), f AS (SELECT DISTINCT source || '/' || lang AS folder FROM documents WHERE doc_id % 7 = 0) SELECT doc_id FROM p WHERE NOT {_BELOW_SQL} OR doc_id % 2 = 0",
)
def pruned_roots(spark, sf_dir):
    base = _paths(spark, sf_dir)
    roots = table(spark, sf_dir, "documents").filter("doc_id % 7 = 0").select(F.concat_ws("/", "source", "lang").alias("folder"))
    return catalog.pruned(base, base.filter("doc_id % 2 = 0"), "path", roots).select("doc_id")


#: Patterns out of the names themselves: a beginning, an end, a middle, both ends, whole names, one character open, and all names of a length.
_PATTERNS = """SELECT DISTINCT unnest(ARRAY[substr(p_name, 1, 5) || '*', '*' || substr(p_name, length(p_name) - 3), '*' || substr(p_name, 3, 4) || '*', substr(p_name, 1, 2) || '*' || substr(p_name, length(p_name)), p_name,
    '?' || substr(p_name, 2), repeat('?', length(p_name)), substr(p_name, 1, 3) || '?' || substr(p_name, 5, 1) || '*']) AS pattern FROM part WHERE p_partkey % 11 = 0"""


@query(
    "pattern_totals",
    f"WITH f AS ({_PATTERNS}) SELECT pattern, count(p_partkey) AS n, CAST(sum(p_size) AS BIGINT) AS total FROM f LEFT JOIN part ON p_name GLOB pattern GROUP BY 1",
)
def pattern_totals(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    end = lambda k: f"substr(p_name, length(p_name) - {k})"
    made = f"""array(concat(substr(p_name, 1, 5), '*'), concat('*', {end(3)}), concat('*', substr(p_name, 3, 4), '*'), concat(substr(p_name, 1, 2), '*', {end(0)}), p_name,
        concat('?', substr(p_name, 2)), repeat('?', length(p_name)), concat(substr(p_name, 1, 3), '?', substr(p_name, 5, 1), '*'))"""
    patterns = parts.filter("p_partkey % 11 = 0").select(F.explode(F.expr(made)).alias("pattern"))
    return prefixes.pattern_sums(parts, "p_name", "p_size", patterns, "pattern")


@query(
    "user_moments",
    """SELECT l_returnflag, l_suppkey, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS sd_pop, round(coalesce(stddev_samp(l_quantity), CASE WHEN count(l_quantity) > 0 THEN 0 END), 6) AS sd_samp FROM lineitem GROUP BY 1, 2""",
)
def user_moments(spark, sf_dir):
    got = aggregates.aggregated(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_suppkey"], ["l_quantity"], aggregates.Welford())
    return got.withColumns({c: F.round(c, 6) for c in ("mean", "sd_pop", "sd_samp")})


@query(
    "user_weighted",
    """WITH r AS (SELECT l_linestatus, CAST(l_extendedprice AS DECIMAL(18,2)) AS x, CAST(round(l_extendedprice * 100) AS HUGEINT) AS c, CAST(l_quantity AS BIGINT) AS w FROM lineitem)
       SELECT l_linestatus, CAST(sum(w) AS DECIMAL(38,0)) AS weight, CAST(sum(x * w) AS DECIMAL(38,6)) AS total, round(CAST(sum(x * w) AS DOUBLE) / sum(w), 3) AS mean,
       round(sqrt(CAST(sum(w) * sum(c * c * w) - sum(c * w) * sum(c * w) AS DOUBLE)) / sum(w) / 100, 3) AS sd FROM r GROUP BY 1""",
)
def user_weighted(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_linestatus", F.col("l_extendedprice").cast("decimal(18,2)").alias("x"), F.col("l_quantity").cast("long").alias("w"))
    got = aggregates.aggregated(rows, ["l_linestatus"], ["x", "w"], aggregates.WeightedDecimals())
    return got.select("l_linestatus", "weight", "total", F.round(F.col("mean").cast("double"), 3).alias("mean"), F.round(F.sqrt(F.col("var_pop").cast("double")), 3).alias("sd"))


PS = (97, 95, 90, 75, 50, 25)
QS = (0.25, 0.5, 0.75, 0.9, 0.99, 0.999)


@query("ranks_nearest", " UNION ALL ".join(f"SELECT l_linestatus, {p} AS p, quantile_disc(l_extendedprice, {p / 100}) AS value FROM lineitem GROUP BY 1" for p in PS))
def ranks_nearest(spark, sf_dir):
    return ranks.nearest_ranks(table(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_extendedprice", PS)


@query("ranks_interpolated", " UNION ALL ".join(f"SELECT event_type, CAST({p} AS DOUBLE) AS p, round(quantile_cont(value, {p}), 6) AS value FROM events WHERE value IS NOT NULL GROUP BY 1" for p in QS))
def ranks_interpolated(spark, sf_dir):
    return ranks.interpolated(table(spark, sf_dir, "events"), ["event_type"], "value", QS).withColumn("value", F.round("value", 6))


@query(
    "ranks_outliers",
    """WITH m AS (SELECT l_returnflag, median(l_extendedprice) AS med FROM lineitem GROUP BY 1), o AS (SELECT lineitem.*, abs(l_extendedprice - med) AS off FROM lineitem JOIN m USING (l_returnflag)),
       d AS (SELECT l_returnflag, median(off) AS mad FROM o GROUP BY 1) SELECT l_orderkey, l_linenumber FROM o JOIN d USING (l_returnflag) WHERE CASE WHEN mad = 0 THEN off > 0 ELSE 0.6745 * off / mad > 1.2 END""",
)
def ranks_outliers(spark, sf_dir):
    return ranks.mad_outliers(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 1.2).select("l_orderkey", "l_linenumber")
