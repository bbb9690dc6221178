"""Further series, path, blob and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from silt.functions import text as T
from silt.operators import graph, series, stats
from silt.plans.registry import query
from silt.sources.tables import table


def micros():
    return F.unix_micros(F.col("ts").cast("timestamp"))


@query(
    "line_pairs",
    """WITH r AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS k FROM conversations)
       SELECT conv_id, (k - 1) // 2 AS pair, string_agg(role, ' ' ORDER BY k) AS joined FROM r GROUP BY 1, 2""",
)
def line_pairs(spark, sf_dir):
    return series.line_pairs(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn", "role"], "role")


@query(
    "speeds",
    """WITH d AS (SELECT event_id, user_id, ts, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS speed FROM events)
       SELECT event_id, round(speed, 6) AS speed, round(avg(speed) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 1e-9, 5) AS mean_speed FROM d""",
)
def speeds(spark, sf_dir):
    got = series.speeds(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")
    return got.select("event_id", F.round("speed", 6).alias("speed"), F.round(F.col("mean_speed") + 1e-9, 5).alias("mean_speed"))


@query(
    "stalls",
    """WITH f AS (SELECT user_id, ts, event_id, CASE WHEN row_number() OVER w = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
       r AS (SELECT *, sum(m) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM f)
       SELECT user_id, min(ts) AS start, count(*) - 1 AS waits FROM r GROUP BY user_id, run HAVING count(*) > 2""",
)
def stalls(spark, sf_dir):
    return series.stalls(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type", 2)


@query(
    "rate_since_start",
    """WITH c AS (SELECT event_id, user_id, ts, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 7 AS counter FROM events),
       d AS (SELECT event_id, counter - coalesce(lag(counter) OVER w, 0) AS dc, (us - coalesce(lag(us) OVER w, epoch_us(TIMESTAMP '2023-12-31'))) / 1000000.0 AS s FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
       SELECT event_id, CASE WHEN s > 0 THEN round(dc / s, 6) END AS rate FROM d""",
)
def rate_since_start(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("counter", F.row_number().over(series.by(["user_id"], ["ts", "event_id"])) * 7)
    got = series.rate_since_start(e, ["user_id"], ["ts", "event_id"], "counter", micros(), F.unix_micros(F.to_timestamp(F.lit("2023-12-31 00:00:00+00:00"))))
    return got.select("event_id", F.round("rate", 6).alias("rate"))


@query(
    "progress_steps",
    """WITH p AS (SELECT event_id, user_id, ts, CAST(floor(100 * row_number() OVER w / count(*) OVER (PARTITION BY user_id)) AS BIGINT) AS percent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
       b AS (SELECT *, coalesce(lag(percent) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS b FROM p) SELECT event_id, percent FROM b WHERE percent > b""",
)
def progress_steps(spark, sf_dir):
    return series.progress_steps(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("event_id", "percent")


@query(
    "throttled_rates",
    """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
       w AS (SELECT user_id, k, t, t AS start, t AS shown, true AS visible FROM e WHERE k = 1 UNION ALL
         SELECT e.user_id, e.k, e.t, w.start, CASE WHEN e.t - w.shown >= 86400000 THEN e.t ELSE w.shown END, e.t - w.shown >= 86400000 FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
       SELECT user_id AS "key", t AS at_ms, CAST(floor(k * 1000 / (t - start) + 0.5) AS BIGINT) AS rate FROM w WHERE visible AND t - start >= 100""",
)
def throttled_rates(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.row_number().over(series.by(["user_id"], ["ts", "event_id"])).alias("n"))
    return series.throttled_rates(e, "user_id", "at_ms", "n", every_ms=86_400_000)


@query(
    "nearest_marked",
    """WITH p AS (SELECT page_id, string_split(regexp_extract(url, '^https?://([^?#]*)', 1), '/') AS parts FROM pages), m AS (SELECT DISTINCT array_to_string(parts[1:len(parts) - 1], '/') AS dir FROM p WHERE ends_with(parts[-1], '.html')),
       a AS (SELECT page_id, k, array_to_string(parts[1:k], '/') AS dir FROM (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM p))
       SELECT p.page_id, f.found FROM p LEFT JOIN (SELECT page_id, max_by(a.dir, k) AS found FROM a JOIN m ON a.dir = m.dir GROUP BY 1) f ON p.page_id = f.page_id""",
)
def nearest_marked(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^?#]*)", 1).alias("path"))
    marked = p.filter(F.col("path").endswith(".html")).select(F.regexp_replace("path", "/[^/]*$", "").alias("dir"))
    return graph.nearest_marked(p, "page_id", "path", marked, "dir")


GLOBS = ("ECO*", "*M*", "small *", "*bolt")


@query("glob_totals", " UNION ALL ".join(f"""SELECT '{g}' AS pattern, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total FROM part WHERE p_type GLOB '{g}' OR p_name GLOB '{g}'""" for g in GLOBS))
def glob_totals(spark, sf_dir):
    fits = lambda g: T.globbed(F.col("p_type"), g) | T.globbed(F.col("p_name"), g)
    matched = F.array_compact(F.array(*[F.when(fits(g), F.lit(g)) for g in GLOBS]))
    return table(spark, sf_dir, "part").select("p_size", F.explode(matched).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"), F.sum("p_size").alias("total"))


@query(
    "byte_diffs",
    """SELECT p_partkey, printf('%08X %02X %02X', i, ascii(substr(p_name, i, 1)), ascii(substr(p_type, i, 1))) AS diff
       FROM (SELECT *, unnest(range(1, least(length(p_name), length(p_type)) + 1)) AS i FROM part) WHERE substr(p_name, i, 1) <> substr(p_type, i, 1)""",
)
def byte_diffs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(T.byte_diffs(F.col("p_name"), F.col("p_type"))).alias("diff"))


@query(
    "lowest_version",
    """SELECT c_mktsegment, arg_min(v, k) AS version FROM (SELECT c_mktsegment, c_nationkey || '.' || c_custkey AS v, [CAST(c_nationkey AS BIGINT), c_custkey] AS k FROM customer) GROUP BY 1""",
)
def lowest_version(spark, sf_dir):
    v = table(spark, sf_dir, "customer").select("c_mktsegment", F.concat_ws(".", F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string")).alias("v"))
    return v.groupBy("c_mktsegment").agg(F.min_by("v", T.version_key(F.col("v"))).alias("version"))


@query(
    "parts_and_rest",
    """SELECT CAST(ts AS DATE) AS day, count(*) AS total, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type NOT IN ('view', 'click') OR event_type IS NULL) AS other FROM events GROUP BY 1""",
)
def parts_and_rest(spark, sf_dir):
    return stats.parts_and_rest(table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_type"), ["day"], "event_type", ["view", "click"])


@query("slice_sums", "SELECT vec_id, round(list_sum(list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE))), 6) AS head, round(list_sum(list_transform(embedding[33:64], lambda x: CAST(x AS DOUBLE))), 6) AS tail FROM embeddings")
def slice_sums(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(stats.slice_sum(e, 1, 32), 6).alias("head"), F.round(stats.slice_sum(e, 33, 32), 6).alias("tail"))


@query("round_trip", "SELECT doc_id, md5(decode(from_base64(base64(encode(text))))) AS md5 FROM documents WHERE text IS NOT NULL")
def round_trip(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.md5(F.unbase64(F.base64(F.encode("text", "utf-8")))).alias("back"))
    return d.filter("md5 = back").select("doc_id", "md5")


@query(
    "scaled_bars",
    """WITH c AS (SELECT l_linenumber, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_linenumber, n, repeat('∎', CAST(floor(n / greatest(1, ceil((SELECT max(n) FROM c) / 75))) AS INTEGER)) AS line_bar FROM c""",
)
def scaled_bars(spark, sf_dir):
    return stats.scaled_bars(table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("n")), "n")
