"""Statistics, series and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from silt.operators import series as ser
from silt.operators import stats as op
from silt.plans.registry import query
from silt.sources.tables import table



def _round(df, *cols, to=6):
    for c in cols:
        df = df.withColumn(c, F.round(c, to))
    return df


@query(
    "summary_stats",
    """SELECT l_returnflag, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS sd_pop, round(coalesce(stddev_samp(l_quantity), 0), 6) AS sd_samp,
       median(l_quantity) AS median, min(l_quantity) AS min, max(l_quantity) AS max, round(CASE WHEN sum(l_quantity) > 0 THEN 100 * coalesce(stddev_samp(l_quantity), 0) / avg(l_quantity) ELSE 0 END, 6) AS cv_pct FROM lineitem GROUP BY 1""",
)
def summary_stats(spark, sf_dir):
    return _round(op.summary(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity"), "mean", "sd_pop", "sd_samp", "cv_pct")


PS = (97, 95, 90, 75, 50, 25)


@query("percentile_rank", " UNION ALL ".join(f"SELECT l_returnflag, {p} AS p, quantile_disc(l_extendedprice, {p / 100}) AS value FROM lineitem GROUP BY 1" for p in PS))
def percentile_rank(spark, sf_dir):
    return op.percentiles_by_rank(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", PS)


QS = (0.25, 0.5, 0.75, 0.9, 0.99, 0.999, 0.9999, 0.99999)


@query("percentile_interp", " UNION ALL ".join(f"SELECT l_returnflag, CAST({p} AS DOUBLE) AS p, round(quantile_cont(l_extendedprice, {p}), 4) AS value FROM lineitem GROUP BY 1" for p in QS))
def percentile_interp(spark, sf_dir):
    return _round(op.percentiles_interpolated(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", QS), "value", to=4)


@query(
    "percentile_exclusive",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
       q AS (SELECT *, greatest(1, least(floor(0.95 * (n + 1)), n - 1)) AS lo FROM r)
       SELECT event_type, round(sum(CASE WHEN k = lo THEN value * (1 - least(1, greatest(0, 0.95 * (n + 1) - lo))) ELSE value * least(1, greatest(0, 0.95 * (n + 1) - lo)) END), 6) AS value FROM q WHERE k IN (lo, lo + 1) GROUP BY 1""",
)
def percentile_exclusive(spark, sf_dir):
    return _round(op.percentile_exclusive(table(spark, sf_dir, "events"), ["event_type"], "value", 0.95), "value")


@query(
    "mad_outliers",
    """WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1), d AS (SELECT e.event_id, e.event_type, e.value, abs(e.value - med) AS off FROM events e JOIN m ON e.event_type = m.event_type),
       s AS (SELECT event_type, median(off) AS mad FROM d GROUP BY 1) SELECT event_id, d.event_type, value FROM d JOIN s ON d.event_type = s.event_type WHERE CASE WHEN mad = 0 THEN off > 0 ELSE 0.6745 * off / mad > 3.5 END""",
)
def mad_outliers(spark, sf_dir):
    return op.mad_outliers(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), ["event_type"], "value").select("event_id", "event_type", "value")


def _bins_sql(source: str, bin_of: str, n: int) -> str:
    return f"""WITH b AS (SELECT CAST({bin_of} AS INTEGER) AS bin, count(*) AS c FROM {source} GROUP BY 1), f AS (SELECT CAST(i AS INTEGER) AS bin, coalesce(c, 0) AS cnt FROM range(1, {n + 1}) t(i) LEFT JOIN b ON b.bin = i)
        SELECT bin, cnt, round(100.0 * cnt / sum(cnt) OVER (), 6) AS pct FROM f"""


@query("hist_linear_left_open", _bins_sql("lineitem", "greatest(1, ceil((l_quantity - 1.0) / 4.9))", 10))
def hist_linear_left_open(spark, sf_dir):
    return _round(op.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", 1.0, 50.0, 10), "pct")


@query("hist_linear_right_open", _bins_sql("lineitem", "least(10, floor((l_quantity - 1.0) / 4.9) + 1)", 10))
def hist_linear_right_open(spark, sf_dir):
    return _round(op.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", 1.0, 50.0, 10, "left"), "pct")


LOG = op.log_edges(0.0, 600_000.0, 8)


@query("hist_log", _bins_sql("(SELECT * FROM orders WHERE o_totalprice <= 600000)", "CASE " + " ".join(f"WHEN o_totalprice <= {e!r} THEN {i}" for i, e in enumerate(LOG, 1)) + " END", 8))
def hist_log(spark, sf_dir):
    return _round(op.histogram_edges(table(spark, sf_dir, "orders"), "o_totalprice", LOG), "pct")


@query("hist_custom", _bins_sql("part", "CASE WHEN p_size <= 3 THEN 1 WHEN p_size <= 10 THEN 2 WHEN p_size <= 25 THEN 3 ELSE 4 END", 4))
def hist_custom(spark, sf_dir):
    return _round(op.histogram_edges(table(spark, sf_dir, "part"), "p_size", [3, 10, 25, 1000]), "pct")


@query("out_of_range", "SELECT count(*) FILTER (WHERE l_quantity < 5 OR l_quantity > 45) AS outside, count(*) AS n FROM lineitem")
def out_of_range(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count_if((F.col("l_quantity") < 5) | (F.col("l_quantity") > 45)).alias("outside"), F.count("*").alias("n"))


@query(
    "weighted_stats",
    """SELECT l_returnflag, sum(l_quantity) AS weight, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean,
       round(sum(l_discount * l_discount * l_quantity) / sum(l_quantity) - (sum(l_discount * l_quantity) / sum(l_quantity)) ^ 2, 6) AS var_pop FROM lineitem GROUP BY 1""",
)
def weighted_stats(spark, sf_dir):
    return _round(op.weighted(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity"), "mean", "var_pop")


@query("group_count", "SELECT event_type, count(*) AS n, repeat('=', CAST(count(*) // 100 AS INTEGER)) AS bar FROM events GROUP BY 1")
def group_count(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("bar", op.bar(F.floor(F.col("n") / 100)))


@query("cond_counts", "SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS seen, CAST(sum(CASE WHEN event_type NOT LIKE '%r%' THEN 1 ELSE 0 END) AS BIGINT) AS without_r FROM events GROUP BY 1")
def cond_counts(spark, sf_dir):
    e = F.col("event_type")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(e == "error").alias("errors"), F.count_if(e.isin("view", "click")).alias("seen"), F.sum(F.when(e.rlike("r"), 0).otherwise(1)).alias("without_r"))


@query("request_summary", "SELECT count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type <> 'error') AS done, round(avg(value) FILTER (WHERE event_type <> 'error'), 6) AS mean_value FROM events")
def request_summary(spark, sf_dir):
    bad = F.col("event_type") == "error"
    return _round(table(spark, sf_dir, "events").agg(F.count_if(bad).alias("failed"), F.count_if(~bad).alias("done"), F.avg(F.when(~bad, F.col("value"))).alias("mean_value")), "mean_value")


@query("running_total", "SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running_total FROM orders")
def running_total(spark, sf_dir):
    return _round(ser.running_total(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_custkey", "o_orderkey", "running_total"), "running_total", to=2)


@query(
    "running_stats",
    """SELECT event_id, n, round(mean + 1e-7, 4) AS mean, round(sd + 1e-7, 4) AS sd FROM (SELECT event_id, count(value) OVER w AS n, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS sd FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) WHERE n >= 3""",
)
def running_stats(spark, sf_dir):
    got = ser.running_stats(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")
    nudge = lambda c: F.round(F.col(c) + 1e-7, 4).alias(c)  # noqa: E731  means of cents fall on ties, which engines round differently
    return got.select("event_id", "n", nudge("mean"), nudge("sd"))


def micros():
    return F.unix_micros(F.col("ts").cast("timestamp"))


@query("gaps", "SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_us FROM events")
def gaps(spark, sf_dir):
    return ser.gaps(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], micros()).select("event_id", "gap_us")


@query(
    "counter_rate",
    """WITH c AS (SELECT event_id, user_id, ts, (event_id * 37) % 1000 AS counter FROM events), d AS (SELECT event_id, counter - lag(counter) OVER w AS dc, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1000000.0 AS s FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
       SELECT event_id, CASE WHEN s > 0 THEN round((CASE WHEN dc < 0 THEN dc + 1000 ELSE dc END) * 512.0 / s, 6) END AS rate FROM d""",
)
def counter_rate(spark, sf_dir):
    c = table(spark, sf_dir, "events").withColumn("counter", F.expr("(event_id * 37) % 1000"))
    return _round(ser.counter_rate(c, ["user_id"], ["ts", "event_id"], "counter", micros(), 512.0, 999).select("event_id", "rate"), "rate")


@query(
    "delta_share",
    """SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY CAST(ts AS DATE)), 6) AS share_pct FROM events GROUP BY 1, 2""",
)
def delta_share(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    return _round(ser.shares(n, ["day"], "n"), "share_pct")


@query("missed_ticks", "SELECT event_id, gap_us, gap_us // 3600000000 AS missed FROM (SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_us FROM events) WHERE gap_us > 3600000000")
def missed_ticks(spark, sf_dir):
    return ser.late_ticks(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], micros(), 3_600_000_000).select("event_id", "gap_us", "missed")


@query("dedupe_consecutive", "SELECT event_id, event_type FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE event_type IS DISTINCT FROM p")
def dedupe_consecutive(spark, sf_dir):
    return ser.changes(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "event_type")


@query("tail_n", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 40")
def tail_n(spark, sf_dir):
    return ser.last_rows(table(spark, sf_dir, "events").select("event_id", "ts"), [F.desc("ts"), F.desc("event_id")], 40)


@query("topk", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def topk(spark, sf_dir):
    return ser.last_rows(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), F.asc("p_partkey")], 25)


@query("stable_merge", "SELECT event_id, ts, CASE WHEN event_type = 'error' THEN 'err' ELSE 'out' END AS stream FROM events WHERE event_type IN ('error', 'view') ORDER BY ts, stream DESC, event_id")
def stable_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return ser.merged(e.filter("event_type = 'view'").drop("event_type"), e.filter("event_type = 'error'").drop("event_type"), ["ts", "event_id"])


@query(
    "pairing",
    """WITH r AS (SELECT conv_id, turn, role, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
       SELECT conv_id, turn, md5(nt) AS answer FROM r WHERE role = 'user' AND nr = 'assistant'""",
)
def pairing(spark, sf_dir):
    return ser.paired(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role", "user", "assistant", "text").select("conv_id", "turn", F.md5("closed_by").alias("answer"))


@query("ext_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY 1")
def ext_tumbling(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("ext_sliding", "SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY 1")
def ext_sliding(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query(
    "ext_session",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS brk, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
       s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def ext_session(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("t", "2 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
