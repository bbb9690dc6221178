"""Streams with timers, over events that arrive in three slices and out of order; each query equals SQL over all rows."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from silt.operators import shared
from silt.plans.registry import query
from silt.sources.tables import table
from silt.streaming import stateful, timed

#: Events arrive up to an hour late; the watermark waits for two.
_DELAY, LATE = "pmod(xxhash64(event_id), 3600)", "2 hours"


def _sliced(spark, sf_dir, stream):
    """Run ``stream`` over three slices of events by time of arrival, then over a row of a later time that closes everything."""
    at = f"{shared.root(spark)}/timed/{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value").withColumn("arrival", F.unix_seconds("ts") + F.expr(_DELAY))
    a, b, last = events.agg(F.min("arrival"), F.max("arrival"), F.max("ts")).first()
    part = F.expr(f"least(2, CAST((arrival - {a or 0}) * 3 DIV {max(1, (b or 0) - (a or 0))} AS int))")
    put = lambda rows: rows.drop("arrival").write.mode("append").parquet(f"{at}/rows")
    end = spark.createDataFrame([(None, last + timedelta(days=400) if last else None, None, None, None)], events.drop("arrival").schema)
    slices = [lambda k=k: put(events.filter(part == k)) for k in range(3)] + [lambda: put(end)]
    run = lambda: stateful.run_once(stream(stateful.file_stream(spark, f"{at}/rows")), "append", f"{at}/state", f"{at}/out")
    return timed.in_slices(slices, run).drop("batch_")


@query(
    "stream_calls",
    """WITH e AS (SELECT user_id, epoch_us(ts) AS t, event_type AS k FROM events WHERE event_type IN ('view', 'click') AND user_id IS NOT NULL),
       n AS (SELECT *, lag(t) OVER w AS pt, lag(k) OVER w AS pk, lead(t) OVER w AS nt, lead(k) OVER w AS nk FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, k))
       SELECT user_id AS "key", CASE WHEN pk = 'view' AND t - pt <= 43200000000 THEN pt END AS opened, t AS closed FROM n WHERE k = 'click'
       UNION ALL SELECT user_id, t, NULL FROM n WHERE k = 'view' AND NOT coalesce(nk = 'click' AND nt - t <= 43200000000, false)""",
)
def stream_calls(spark, sf_dir):
    return _sliced(spark, sf_dir, lambda s: timed.calls(s, "user_id", "event_type", "ts", "view", "click", 43_200, LATE))


@query(
    "stream_given_up",
    """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, event_type AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type) AS k FROM events WHERE user_id IS NOT NULL),
       w AS (SELECT user_id, k, t AS since, v, CAST(0 AS BIGINT) AS changes, CAST(NULL AS BIGINT) AS gave, CAST(NULL AS BIGINT) AS had FROM e WHERE k = 1
         UNION ALL SELECT e.user_id, e.k, CASE WHEN e.t - w.since > 86400000000 OR e.v IS DISTINCT FROM w.v THEN e.t ELSE w.since END, e.v,
           CASE WHEN e.t - w.since > 86400000000 THEN 0 WHEN e.v IS DISTINCT FROM w.v THEN w.changes + 1 ELSE w.changes END,
           CASE WHEN e.t - w.since > 86400000000 THEN w.since END, CASE WHEN e.t - w.since > 86400000000 THEN w.changes END FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
       SELECT user_id AS "key", gave AS since, had AS changes FROM w WHERE gave IS NOT NULL UNION ALL SELECT user_id, arg_max(since, k), arg_max(changes, k) FROM w GROUP BY 1""",
)
def stream_given_up(spark, sf_dir):
    return _sliced(spark, sf_dir, lambda s: timed.given_up(s, "user_id", "ts", "event_type", 86_400, LATE))


@query(
    "stream_period_rates",
    """WITH e AS (SELECT user_id, epoch_us(ts) AS t, event_id, CAST(event_id AS DOUBLE) AS c, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 172800000000 THEN 1 ELSE 0 END AS fresh FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
       s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run, t // 21600000000 AS p FROM e),
       l AS (SELECT user_id, run, p, arg_max(t, event_id) AS bt, arg_max(c, event_id) AS bc FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id, run, p ORDER BY t DESC, event_id DESC) = 1) GROUP BY 1, 2, 3)
       SELECT s.user_id AS "key", s.t AS "at", CASE WHEN t > bt THEN (c - bc) * 1e6 / (t - bt) END AS rate FROM s ASOF LEFT JOIN l ON s.user_id = l.user_id AND s.run = l.run AND s.p > l.p""",
)
def stream_period_rates(spark, sf_dir):
    return _sliced(spark, sf_dir, lambda s: timed.period_rates(s, "user_id", "ts", "event_id", 21_600, 172_800, LATE, "event_id"))
