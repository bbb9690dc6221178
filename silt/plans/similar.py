"""Similarity joins, graphs, assignment, packing and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from silt.functions import text as T
from silt.operators import assign, graph, shared
from silt.operators import similarity as sim
from silt.plans.registry import query
from silt.sources import sinks
from silt.sources.tables import table
from silt.streaming import stateful


def _hash(n: str) -> str:
    """A stand-in for perceptual hashes: blocks of five rows form a chain whose neighbours differ in three bits."""
    return f"(CAST(conv(substring(md5(CAST({n} DIV 5 AS string)), 1, 15), 16, -10) AS bigint) ^ (shiftleft(1L, CAST(3 * ({n} % 5) AS int)) - 1))"


def _hash_sql(n: str) -> str:
    return f"xor(CAST('0x' || substr(md5(CAST({n} // 5 AS VARCHAR)), 1, 15) AS BIGINT), (1::BIGINT << (3 * ({n} % 5))) - 1)"


def _hashed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_hash("doc_id")).alias("front"), F.expr(_hash("(doc_id DIV 7)")).alias("back"))


_H = f"h AS (SELECT doc_id, {_hash_sql('doc_id')} AS front, {_hash_sql('(doc_id // 7)')} AS back FROM documents)"
def _pairs_sql(bits: str, only: str = "true") -> str:
    """Links between the least documents of different hashes, and of each with the others of its hash."""
    return f"""SELECT x.v AS a, y.v AS b, CAST(bit_count(xor(x.h, y.h)) AS INTEGER) AS distance FROM (SELECT {bits} AS h, min(doc_id) AS v, bool_or({only}) AS hot FROM h GROUP BY 1) x
        JOIN (SELECT {bits} AS h, min(doc_id) AS v, bool_or({only}) AS hot FROM h GROUP BY 1) y ON x.v < y.v AND bit_count(xor(x.h, y.h)) <= 10 AND (x.hot OR y.hot)
        UNION ALL SELECT v AS a, doc_id AS b, 0 AS distance FROM h JOIN (SELECT {bits} AS k, min(doc_id) AS v, bool_or({only}) AS hot FROM h GROUP BY 1) c ON h.{bits} = c.k WHERE doc_id <> v AND hot"""


_PAIRS = _pairs_sql("front")
_CHANGED = "SELECT doc_id FROM labels WHERE toxic = 1"


def _changed(spark, sf_dir):
    """Rows that changed since the last run: here, the documents that were marked since."""
    return table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")


@query("hamming_pairs", f"WITH {_H} {_PAIRS}")
def hamming_pairs(spark, sf_dir):
    return sim.hamming_pairs(_hashed(spark, sf_dir), "doc_id", "front", 10)


@query("hamming_delta", f"WITH {_H} {_pairs_sql('front', f'doc_id IN ({_CHANGED})')}")
def hamming_delta(spark, sf_dir):
    h = _hashed(spark, sf_dir)
    return sim.hamming_pairs(h, "doc_id", "front", 10, h.join(_changed(spark, sf_dir), "doc_id", "left_semi"))


@query("disjunctive_pairs", f"WITH {_H} SELECT a, b FROM ({_pairs_sql('front')}) UNION SELECT a, b FROM ({_pairs_sql('back')})")
def disjunctive_pairs(spark, sf_dir):
    return sim.either_pairs(_hashed(spark, sf_dir), "doc_id", "front", "back", 10)


@query(
    "components",
    f"""WITH RECURSIVE {_H}, p AS ({_PAIRS}), e AS (SELECT a AS n, b AS m FROM p UNION SELECT b, a FROM p), r AS (SELECT n, n AS c FROM e UNION SELECT e.n, r.c FROM e JOIN r ON e.m = r.n)
        SELECT c AS component, count(*) AS size FROM (SELECT n, min(c) AS c FROM r GROUP BY n) GROUP BY 1 HAVING count(*) >= 2""",
)
def components(spark, sf_dir):
    return graph.groups(sim.hamming_pairs(_hashed(spark, sf_dir), "doc_id", "front", 10))


@query("kept_edges", f"WITH {_H}, p AS ({_PAIRS}) SELECT a, b FROM p WHERE a NOT IN ({_CHANGED}) AND b NOT IN ({_CHANGED})")
def kept_edges(spark, sf_dir):
    h = _hashed(spark, sf_dir)
    return graph.kept_edges(sim.hamming_pairs(h, "doc_id", "front", 10).select("a", "b"), _changed(spark, sf_dir), "doc_id")


@query(
    "band_pairs",
    """WITH c AS (SELECT o_totalprice AS x, min(o_orderkey) AS v FROM orders GROUP BY 1) SELECT least(p.v, q.v) AS a, greatest(p.v, q.v) AS b FROM c p JOIN c q ON p.x < q.x AND q.x - p.x <= 3.0
       UNION ALL SELECT v AS a, o_orderkey AS b FROM orders JOIN c ON o_totalprice = x WHERE o_orderkey <> v""",
)
def band_pairs(spark, sf_dir):
    return sim.band_pairs(table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice", 3.0)


@query(
    "edit_distance_pairs",
    """WITH n AS (SELECT p_name, max(p_size) AS s FROM part GROUP BY 1) SELECT x.p_name AS "new", y.p_name AS "old", CAST(levenshtein(x.p_name, y.p_name) AS INTEGER) AS edits FROM n x JOIN n y
       ON levenshtein(x.p_name, y.p_name) <= greatest(1, length(x.p_name) * 30 // 100) AND greatest(x.s, y.s) <= 10 * greatest(1, least(x.s, y.s))""",
)
def edit_distance_pairs(spark, sf_dir):
    names = table(spark, sf_dir, "part").groupBy("p_name").agg(F.max("p_size").alias("s"))
    return sim.edit_pairs(names, names, "p_name", 30, "s")


def _named(spark, sf_dir, *within):
    part = table(spark, sf_dir, "part")
    left = part.select(*within, F.col("p_name").alias("name")).distinct()
    right = part.select(*within, F.concat_ws(" ", "p_type", "p_name").alias("name")).distinct()
    tokens = T.tokens(F.col("name"))
    return assign.scored(left, right, "name", "name", tokens, tokens, lambda a, b: F.round(T.name_score(a, b), 9), 0.3, within)


def _scored_sql(within: str = "") -> str:
    """Scores of names against types and names; names have two words, so their common subsequence is told by cases."""
    words = lambda t: f"list_filter(regexp_split_to_array(lower({t}), '[^a-z0-9]+'), lambda x: x <> '')"
    weight = "CASE WHEN (starts_with(t, 's') AND contains(t, 'e')) OR contains(t, 'x') OR regexp_matches(t, '^[0-9]+(\\.[0-9]+)*$') THEN 2.0 ELSE 1.0 END"
    total = lambda xs: f"CAST(list_sum(list_transform({xs}, lambda t: {weight})) AS DOUBLE)"
    w = f"{within}, " if within else ""
    both = f"l.{within} = r.{within}" if within else "true"
    shared = f"coalesce(CAST(list_sum(list_transform(list_distinct(list_intersect(lt, rt)), lambda t: ({weight}) * least(len(list_filter(lt, lambda y: y = t)), len(list_filter(rt, lambda y: y = t))))) AS DOUBLE), 0)"
    lcs = "CASE WHEN list_contains(rt, lt[1]) AND list_contains(rt[list_position(rt, lt[1]) + 1:], lt[2]) THEN 2 WHEN list_contains(rt, lt[1]) OR list_contains(rt, lt[2]) THEN 1 ELSE 0 END"
    return f"""left_names AS (SELECT DISTINCT {w}p_name AS l, {words("p_name")} AS lt FROM part), right_names AS (SELECT DISTINCT {w}p_type || ' ' || p_name AS r, {words("p_type || ' ' || p_name")} AS rt FROM part),
        pairs AS (SELECT * FROM (SELECT {f"l.{within}, " if within else ""}l, r, round(0.6 * (2 * {shared} / ({total("lt")} + {total("rt")})) + 0.4 * (2.0 * {lcs} / (len(lt) + len(rt))), 9) AS score
        FROM left_names l JOIN right_names r ON {both} WHERE len(list_intersect(lt, rt)) > 0) WHERE score >= 0.3)"""


@query("best_match", f"WITH {_scored_sql()} SELECT l, r, score FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY score DESC, r) AS k FROM pairs) WHERE k = 1")
def best_match(spark, sf_dir):
    return assign.best_match(_named(spark, sf_dir))


@query(
    "greedy_assign",
    f"""WITH RECURSIVE {_scored_sql("p_brand")}, lefts AS (SELECT p_brand, l, row_number() OVER (PARTITION BY p_brand ORDER BY l) AS k FROM (SELECT DISTINCT p_brand, l FROM pairs)),
        walk AS (SELECT DISTINCT p_brand, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS VARCHAR) AS l, CAST(NULL AS VARCHAR) AS r, CAST(NULL AS DOUBLE) AS score FROM lefts
          UNION ALL SELECT w.p_brand, w.k + 1, CASE WHEN b.r IS NULL THEN w.taken ELSE list_append(w.taken, b.r) END, t.l, b.r, b.score FROM walk w JOIN lefts t ON t.p_brand = w.p_brand AND t.k = w.k + 1
          LEFT JOIN LATERAL (SELECT p.r, p.score FROM pairs p WHERE p.p_brand = w.p_brand AND p.l = t.l AND NOT list_contains(w.taken, p.r) ORDER BY p.score DESC, p.r LIMIT 1) b ON true)
        SELECT p_brand, l, r, score FROM walk WHERE r IS NOT NULL""",
)
def greedy_assign(spark, sf_dir):
    return assign.greedy_assignment(_named(spark, sf_dir, "p_brand"), "p_brand")


@query(
    "subset_sum",
    """WITH RECURSIVE i AS (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part WHERE p_size BETWEEN 1 AND 1000),
       r AS (SELECT DISTINCT p_brand, 0 AS s, CAST(0 AS BIGINT) AS step FROM part
             UNION SELECT r.p_brand, r.s + i.p_size * u.used, i.k FROM r JOIN i ON r.p_brand = i.p_brand AND i.k = r.step + 1 JOIN (VALUES (0), (1)) u(used) ON r.s + i.p_size * u.used <= 1000)
       SELECT p_brand, CAST(max(s) AS BIGINT) AS filled FROM r GROUP BY 1""",
)
def subset_sum(spark, sf_dir):
    return assign.subset_sum(table(spark, sf_dir, "part"), ["p_brand"], "p_size", 1000, "p_partkey").select("p_brand", "filled")


@query(
    "caption_merge",
    """WITH RECURSIVE c AS (SELECT conv_id, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
       m AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS k, '' AS said FROM c UNION ALL SELECT conv_id, k + 1, CASE WHEN said = '' THEN t WHEN n > 0 THEN said || substr(t, n + 1) ELSE said || ' ' || t END
         FROM (SELECT m.conv_id, m.k, said, t, coalesce(list_max(list_filter(range(1, least(length(said), length(t)) + 1), lambda n: "right"(said, n) = "left"(t, n))), 0) AS n FROM m JOIN c ON c.conv_id = m.conv_id AND c.k = m.k + 1))
       SELECT conv_id, arg_max(said, k) AS text FROM m GROUP BY 1""",
)
def caption_merge(spark, sf_dir):
    return assign.merged_captions(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


def _places(spark) -> tuple[str, str]:
    at = f"{shared.root(spark)}/streams/{uuid.uuid4().hex}"
    return f"{at}/state", f"{at}/rows"


@query("stream_welford", "SELECT event_type AS key, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM events GROUP BY 1")
def stream_welford(spark, sf_dir):
    got = stateful.run_once(stateful.moments(stateful.file_stream(spark, f"{sf_dir}/events.parquet"), "event_type", "value"), "update", *_places(spark))
    last = got.groupBy("key").agg(F.max_by(F.struct("n", "mean", "sd"), "batch_").alias("s"))
    return last.select("key", "s.n", F.round("s.mean", 6).alias("mean"), F.round("s.sd", 6).alias("sd"))


@query(
    "stream_pairing",
    """WITH r AS (SELECT conv_id, turn, role, lag(role) OVER w AS before, lag(turn) OVER w AS earlier FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
       SELECT conv_id AS "key", CASE WHEN before = 'user' THEN earlier END AS opened, turn AS closed FROM r WHERE role = 'assistant'""",
)
def stream_pairing(spark, sf_dir):
    rows = stateful.file_stream(spark, f"{sf_dir}/conversations.parquet")
    return stateful.run_once(stateful.pairs(rows, "conv_id", "role", "turn", "user", "assistant"), "append", *_places(spark)).drop("batch_")


@query(
    "stream_ticks",
    """SELECT s AS start, event_type, max_by(value, ts) AS last, count(*) AS n FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS s FROM events)
       WHERE s + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY 1, 2""",
)
def stream_ticks(spark, sf_dir):
    rows = stateful.file_stream(spark, f"{sf_dir}/events.parquet")
    return stateful.run_once(stateful.ticks(rows, "ts", "event_type", "value", "1 hour"), "append", *_places(spark)).drop("batch_").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "stream_growth",
    """WITH f AS (SELECT user_id, event_id, CASE WHEN row_number() OVER w = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
       r AS (SELECT *, sum(m) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) AS k FROM r)
       SELECT user_id AS "key", event_id AS "at" FROM k WHERE k = 3""",
)
def stream_growth(spark, sf_dir):
    rows = stateful.file_stream(spark, f"{sf_dir}/events.parquet")
    return stateful.run_once(stateful.growth(rows, "user_id", "event_id", "event_type", 2), "append", *_places(spark)).drop("batch_")


@query(
    "stream_rates",
    """WITH RECURSIVE e AS (SELECT user_id, event_id * 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
       w AS (SELECT user_id, k, t, t AS start, t AS shown, true AS visible FROM e WHERE k = 1 UNION ALL
         SELECT e.user_id, e.k, e.t, w.start, CASE WHEN e.t - w.shown >= 3000000 THEN e.t ELSE w.shown END, e.t - w.shown >= 3000000 FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
       SELECT user_id AS "key", t AS at_ms, CAST(floor(k * 5000 / (t - start) + 0.5) AS BIGINT) AS rate FROM w WHERE visible AND t - start >= 100""",
)
def stream_rates(spark, sf_dir):
    rows = stateful.file_stream(spark, f"{sf_dir}/events.parquet").select("user_id", (F.col("event_id") * 1000).alias("at"), F.lit(5).alias("n"))
    return stateful.run_once(stateful.rates(rows, "user_id", "at", "n", every_ms=3_000_000), "append", *_places(spark)).drop("batch_")


@query("stream_tagged", "SELECT event_id, 'err' AS stream FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, 'out' FROM events WHERE event_type = 'view'")
def stream_tagged(spark, sf_dir):
    rows = stateful.file_stream(spark, f"{sf_dir}/events.parquet")
    both = stateful.tagged(rows.filter("event_type = 'view'"), rows.filter("event_type = 'error'")).select("event_id", "stream")
    return stateful.run_once(both, "append", *_places(spark)).drop("batch_")


@query("stream_dispatch", "SELECT event_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0 THEN 'even' ELSE 'odd' END AS route FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def stream_dispatch(spark, sf_dir):
    rows = stateful.file_stream(spark, f"{sf_dir}/events.parquet").withColumn("k", F.try_variant_get(F.try_parse_json("props"), "$.k", "int")).filter("k IS NOT NULL")
    return stateful.run_once(rows.select("event_id", F.when(F.col("k") % 2 == 0, "even").otherwise("odd").alias("route")), "append", *_places(spark)).drop("batch_")


@query("playlists", "SELECT p_brand AS playlist, row_number() OVER (PARTITION BY p_brand ORDER BY t) AS pos, t AS line FROM (SELECT p_brand, p_name || ' ' || p_partkey AS t FROM part) UNION ALL SELECT DISTINCT p_brand, 0, '#EXTM3U' FROM part")
def playlists(spark, sf_dir):
    return sinks.playlist_lines(table(spark, sf_dir, "part").select("p_brand", F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("t")), "p_brand", "t")


@query("benchmark_json", """SELECT o_orderstatus, '{"config":{"model":"m","requests":4},"results":{"n":' || count(*) || '}}' AS doc FROM orders GROUP BY 1""")
def benchmark_json(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return runs.select("o_orderstatus", sinks.benchmark_json({"model": "m", "requests": 4}, ["n"]).alias("doc"))


@query("console_numbers", "SELECT o_orderkey, lpad(CASE WHEN length(v::VARCHAR) <= 5 THEN v::VARCHAR WHEN length((v // 1024)::VARCHAR) <= 4 THEN (v // 1024) || 'k' WHEN length((v // 1048576)::VARCHAR) <= 4 THEN (v // 1048576) || 'M' ELSE (v // 1073741824) || 'G' END, 5, ' ') AS shown FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 1000) AS v FROM orders)")
def console_numbers(spark, sf_dir):
    v = F.floor("o_totalprice") * (F.col("o_orderkey") % 1000)
    return table(spark, sf_dir, "orders").select("o_orderkey", sinks.fitted(v, 5).alias("shown"))
