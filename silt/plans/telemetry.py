"""Metric views: totals, discovery, rates of tuples and against baselines, telemetry lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from silt.operators import series, telemetry
from silt.plans.registry import query
from silt.sources.tables import table

VIEWS = telemetry.Views()


@VIEWS.register("load", needs=["event_type", "props"], instead=["volume"])
def _load(df):
    return df.groupBy("event_type").agg(F.count("props").alias("n"))


@VIEWS.register("detail", needs=["no_such_column"], instead=["volume", "load"])
def _detail(df):
    raise AssertionError("never shown")


@VIEWS.register("volume", needs=["event_type"])
def _volume(df):
    return df.groupBy("event_type").agg(F.count("*").alias("n"))


@query("view_fallback", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def view_fallback(spark, sf_dir):
    return VIEWS.show(table(spark, sf_dir, "events"), "detail")


@query(
    "entity_totals",
    """SELECT CAST(ts AS DATE) AS day, CAST(coalesce(sum(event_id) FILTER (WHERE NOT regexp_full_match(event_type, 'error|sign.*')), 0) AS BIGINT) AS event_id,
       CAST(coalesce(sum(user_id) FILTER (WHERE NOT regexp_full_match(event_type, 'error|sign.*')), 0) AS BIGINT) AS user_id FROM events GROUP BY 1""",
)
def entity_totals(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return telemetry.totals(e, ["day"], "event_type", ["event_id", "user_id"], "error|sign.*")


@query("active_entities", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount <> 0 OR l_tax <> 0")
def active_entities(spark, sf_dir):
    return telemetry.active(table(spark, sf_dir, "lineitem"), ["l_discount", "l_tax"]).select("l_orderkey", "l_linenumber")


@query("discovered_entities", "SELECT user_id, count(*) AS seen FROM events GROUP BY 1 HAVING count(*) > 10")
def discovered_entities(spark, sf_dir):
    return telemetry.discovered(table(spark, sf_dir, "events"), "user_id", 10)


@query(
    "sums_with_overall",
    """WITH s AS (SELECT CAST(l_linenumber AS VARCHAR) AS l_linenumber, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY 1 HAVING sum(CAST(l_quantity AS BIGINT)) <> 0)
       SELECT * FROM s UNION ALL SELECT 'total', CAST(sum(q) AS BIGINT) FROM s""",
)
def sums_with_overall(spark, sf_dir):
    return telemetry.with_overall(table(spark, sf_dir, "lineitem").select("l_linenumber", F.col("l_quantity").cast("long").alias("q")), "l_linenumber", "q")


@query("memory_used", "SELECT p_partkey, CAST(100000 - p_size * 10 - p_partkey % 97 - p_size - p_partkey % 13 + p_partkey % 7 AS BIGINT) AS used FROM part")
def memory_used(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size").cast("long")
    used = telemetry.used_memory(F.lit(100000).cast("long"), s * 10, k % 97, s, k % 13, k % 7)
    return table(spark, sf_dir, "part").select("p_partkey", used.alias("used"))


@query(
    "tuple_rates",
    """WITH r AS (SELECT event_id, ts, user_id, [CAST(event_id AS DOUBLE), value] AS now, lag([CAST(event_id AS DOUBLE), value]) OVER w AS before, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1000000.0 AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
       SELECT event_id, CASE WHEN s > 0 THEN round((now[1] - before[1]) * 512 / s, 6) END AS first, CASE WHEN s > 0 THEN round((now[2] - before[2]) * 512 / s, 6) END AS second FROM r WHERE before IS NOT NULL""",
)
def tuple_rates(spark, sf_dir):
    w = series.by(["user_id"], ["ts", "event_id"])
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").withColumn("now", F.array(F.col("event_id").cast("double"), "value")).withColumn("before", F.lag("now").over(w)).withColumn("s", (us - F.lag(us).over(w)) / 1e6)
    rated = e.filter("before IS NOT NULL").withColumn("r", telemetry.tuple_rates(F.col("before"), F.col("now"), F.col("s"), 512.0))
    return rated.select("event_id", F.round(F.col("r")[0], 6).alias("first"), F.round(F.col("r")[1], 6).alias("second"))


@query(
    "baseline_rates",
    """WITH e AS (SELECT event_id, user_id, CAST(epoch(ts) AS BIGINT) AS t, CAST(floor(epoch(ts)) AS BIGINT) // 86400 AS p FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events)),
       l AS (SELECT user_id, p, max_by(event_id, (t, event_id)) AS c, max(t) AS t FROM e GROUP BY 1, 2),
       b AS (SELECT e.event_id, e.t, l.c, l.t AS bt, row_number() OVER (PARTITION BY e.event_id ORDER BY l.p DESC) AS k FROM e LEFT JOIN l ON e.user_id = l.user_id AND l.p < e.p)
       SELECT event_id, CASE WHEN t > bt THEN round((event_id - c) / (t - bt), 9) END AS rate FROM b WHERE k = 1""",
)
def baseline_rates(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    got = telemetry.baseline_rates(e, ["user_id"], ["t", "event_id"], "event_id", F.col("t"), 86400)
    return got.select("event_id", F.round("rate", 9).alias("rate"))


@query(
    "telemetry_lines",
    """SELECT 0 AS part, CAST(0 AS BIGINT) AS "at", '"Host: here"' AS line UNION ALL SELECT 1, 0, '"system","load",' UNION ALL SELECT 2, 0, '"day","views","clicks"'
       UNION ALL SELECT 3, d, d || ',' || v || ',' || c FROM (SELECT CAST(epoch(ts) AS BIGINT) // 86400 AS d, count(*) FILTER (WHERE event_type = 'view') AS v, count(*) FILTER (WHERE event_type = 'click') AS c
       FROM (SELECT date_trunc('day', ts) AS ts, event_type FROM events) GROUP BY 1)""",
)
def telemetry_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400))
    days = e.groupBy("day").agg(F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("event_type") == "click").alias("clicks"))
    return telemetry.csv_lines(days, ["day"], [("system", ["day"]), ("load", ["views", "clicks"])], ["Host: here"])
