"""Queries over lines, captions, JSON documents and catalogue reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from silt.functions import media
from silt.functions import text as T
from silt.operators import lines
from silt.operators import similarity as sim
from silt.plans.registry import query
from silt.plans.similar import _H, _hashed, _pairs_sql
from silt.sources.tables import table

_LINES = "(SELECT doc_id, CAST(unnest(range(1, len(l) + 1)) AS BIGINT) AS number, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


def _numbered(spark, sf_dir):
    return lines.numbered(table(spark, sf_dir, "documents"), ["doc_id"], "text")


@query("grep_lines", f"SELECT doc_id, number, md5(line) AS line FROM {_LINES} WHERE regexp_matches(line, '(?i)licen[cs]e')")
def grep_lines(spark, sf_dir):
    return lines.grep(_numbered(spark, sf_dir), "licen[cs]e", ignore_case=True).withColumn("line", F.md5("line"))


@query("grep_inverted", f"SELECT doc_id, number, md5(line) AS line FROM {_LINES} WHERE NOT regexp_matches(line, '[aeiou]')")
def grep_inverted(spark, sf_dir):
    return lines.grep(_numbered(spark, sf_dir), "[aeiou]", invert=True).withColumn("line", F.md5("line"))


@query("first_match", f"SELECT doc_id, min(number) AS number FROM {_LINES} WHERE regexp_matches(line, '[0-9]') GROUP BY 1")
def first_match(spark, sf_dir):
    return lines.first_match(_numbered(spark, sf_dir), ["doc_id"], ["number"], "[0-9]").select("doc_id", "number")


@query("recent_exclusions", "SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '(?:zzq[0-9]+)|(?:\\|)|(?:###)')")
def recent_exclusions(spark, sf_dir):
    kept = lines.recent(["e", *(f"zzq{i}" for i in range(38))], [r"\|", "###"])  # the first one is the oldest of 41 and goes
    return table(spark, sf_dir, "documents").filter(~F.col("text").rlike("|".join(f"(?:{p})" for p in kept))).select("doc_id")


@query(
    "minute_headers",
    """WITH d AS (SELECT event_id, user_id, ts, event_type, strftime(ts, '%H:%M') AS h, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
       k AS (SELECT *, lag(h) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM d WHERE event_type IS DISTINCT FROM b)
       SELECT event_id, CASE WHEN h IS DISTINCT FROM p THEN h END AS header FROM k""",
)
def minute_headers(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("stamp", F.date_format("ts", "HH:mm:ss.SSS"))
    return lines.with_headers(e, ["user_id"], ["ts", "event_id"], "event_type", T.minute_key(F.col("stamp"))).select("event_id", "header")


_SAID = "(SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '>> ' || text ELSE text END, ' ' ORDER BY turn) AS said FROM (SELECT conv_id, turn, role, text FROM conversations WHERE text IS NOT NULL ORDER BY conv_id, turn) GROUP BY 1)"


def _said(spark, sf_dir):
    """Conversations as captions: what users say begins with the speaker mark."""
    c = table(spark, sf_dir, "conversations").filter("text IS NOT NULL").withColumn("t", F.when(F.col("role") == "user", F.concat(F.lit(">> "), "text")).otherwise(F.col("text")))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda r: r["t"]), " ").alias("said"))


@query(
    "speaker_lines",
    f"""WITH p AS (SELECT conv_id, unnest(list_zip(range(len(x)), x)) AS p FROM (SELECT conv_id, string_split(said, '>>') AS x FROM {_SAID}))
        SELECT conv_id, CASE WHEN p[1] > 0 THEN '>> ' ELSE '' END || trim(p[2]) AS part FROM p WHERE trim(p[2]) <> ''""",
)
def speaker_lines(spark, sf_dir):
    return _said(spark, sf_dir).select("conv_id", F.explode(T.speaker_parts(F.col("said"))).alias("part"))


@query(
    "wrapped_text",
    """WITH w AS (SELECT conv_id, turn, list_prepend('', list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS words FROM conversations WHERE text IS NOT NULL)
       SELECT conv_id, turn, list_reduce(words, lambda a, w: CASE
         WHEN length(CASE WHEN contains(a, chr(10)) THEN string_split(a, chr(10))[-1] ELSE a END) + (CASE WHEN a = '' OR contains(a, chr(10)) THEN 0 ELSE 1 END) + length(w) + 1 <= 80
         THEN CASE WHEN a = '' THEN w ELSE a || ' ' || w END ELSE a || chr(10) || w END) AS wrapped FROM w""",
)
def wrapped_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", T.wrapped(F.col("text"), 80).alias("wrapped"))


@query("caption_clock", "SELECT conv_id, turn, strftime(make_timestamp(turn * 61000000), '%H:%M') AS minute, strftime(make_timestamp(turn * 61000000), '%d-%m %H:%M:%S') AS tick FROM conversations")
def caption_clock(spark, sf_dir):
    at = F.timestamp_seconds(F.col("turn") * 61)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.minute_key(F.date_format(at, "HH:mm:ss")).alias("minute"), F.date_format(at, "dd-MM HH:mm:ss").alias("tick"))


@query(
    "zone_log_gaps",
    """WITH l AS (SELECT event_id, user_id, epoch(date_trunc('second', ts)) AS s FROM events WHERE event_type <> 'error'), g AS (SELECT event_id, CAST(s - lag(s) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS seconds FROM l)
       SELECT * FROM g WHERE seconds IS NOT NULL""",
)
def zone_log_gaps(spark, sf_dir):
    zone = F.when(F.col("event_type") == "error", "CEST").otherwise("EET")
    log = table(spark, sf_dir, "events").select("event_id", "user_id", F.concat_ws(" ", F.date_format("ts", "E dd MMM yyyy hh:mm:ss a"), zone).alias("line"))
    return lines.zone_times(log, T.locale_time(F.col("line"), "EET"), ["event_id"], ["user_id"]).select("event_id", "seconds")


@query("time_report", "SELECT l_linenumber * 60 + CAST(l_quantity AS INTEGER) AS seconds, count(*) AS n FROM lineitem GROUP BY 1")
def time_report(spark, sf_dir):
    out = table(spark, sf_dir, "lineitem").select(F.explode(F.array(F.format_string("real\t%dm%d.123s", "l_linenumber", F.col("l_quantity").cast("int")), F.lit("user\t0m0.100s"))).alias("line"))
    return out.filter(F.col("line").startswith("real")).groupBy(T.real_seconds(F.col("line")).alias("seconds")).agg(F.count("*").alias("n"))


@query(
    "disk_results",
    "SELECT p_partkey, (p_size * 10) || 'MiB/s' AS bandwidth, CASE WHEN p_partkey % 3 > 0 THEN p_size || 'k' END AS iops FROM part",
)
def disk_results(spark, sf_dir):
    iops = F.when(F.col("p_partkey") % 3 > 0, F.format_string("IOPS=%dk, ", "p_size")).otherwise(F.lit(""))
    line = F.concat(F.lit("  read: "), iops, F.lit("BW="), (F.col("p_size") * 10).cast("string"), F.lit("MiB/s (1MB/s)(10GiB/60s)"))
    return table(spark, sf_dir, "part").select("p_partkey", T.disk_result(line).alias("r")).select("p_partkey", "r.*")


@query("field_ranges", "SELECT p_partkey, lower(to_hex(p_partkey)) AS start, lower(to_hex(p_partkey * 4096 + p_size)) AS stop FROM part")
def field_ranges(spark, sf_dir):
    k = F.col("p_partkey")
    line = F.concat(F.lower(F.hex(k)), F.lit("-"), F.lower(F.hex(k * 4096 + F.col("p_size"))), F.lit(" rw-p 00000000 00:00 0"))
    return table(spark, sf_dir, "part").select("p_partkey", T.field_range(line).alias("r")).select("p_partkey", "r.*")


@query(
    "clip_and_translate",
    "SELECT c_custkey, string_split(c_name, '#')[1] AS clipped, hex(encode(c_name)) || '00' || hex(encode(c_mktsegment)) AS zeroed FROM customer",
)
def clip_and_translate(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = F.replace(F.col("c_name"), F.lit("#"), F.lit("."))
    return c.select("c_custkey", T.clipped(name).alias("clipped"), F.hex(F.encode(T.nul_separated(F.concat_ws("\n", "c_name", "c_mktsegment")), "utf-8")).alias("zeroed"))


@query("media_ideals", "SELECT p_partkey, round(CAST(p_size AS DOUBLE) * 16 * p_size * 9 * 25 * 0.05, 6) AS ideal, CASE WHEN p_size % 5 = 0 THEN 0.0 WHEN p_partkey % 4 > 0 THEN round(CAST(p_size % 5 AS DOUBLE) / (p_partkey % 4), 9) ELSE CAST('inf' AS DOUBLE) END AS tps FROM part")
def media_ideals(spark, sf_dir):
    w, h = F.col("p_size") * 16.0, F.col("p_size") * 9.0
    tps = T.tokens_per_second((F.col("p_size") % 5).cast("double"), (F.col("p_partkey") % 4).cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(T.ideal_bitrate(w, h, F.lit(25.0)), 6).alias("ideal"), F.when(tps == float("inf"), tps).otherwise(F.round(tps, 9)).alias("tps"))


@query(
    "json_leaves",
    """SELECT p_partkey, 'a.b.[0]' AS path, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT p_partkey, 'a.b.[1].c', p_brand FROM part UNION ALL SELECT p_partkey, 'a.on', 'true' FROM part WHERE p_size > 20
       UNION ALL SELECT p_partkey, 'n', p_name FROM part WHERE p_partkey % 2 = 0""",
)
def json_leaves(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('"'), "p_name", F.lit('"'))).otherwise(F.lit("null"))
    doc = F.concat(F.lit('{"a": {"b": ['), F.col("p_size").cast("string"), F.lit(', {"c": "'), F.col("p_brand"), F.lit('"}], "on": '), (F.col("p_size") > 20).cast("string"), F.lit('}, "n": '), name, F.lit("}"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(T.json_leaves(doc)).alias("leaf")).select("p_partkey", "leaf.*")


@query(
    "media_summary",
    """SELECT l_orderkey, max(l_quantity) FILTER (WHERE l_linenumber % 3 > 0) AS duration, coalesce(sum(CAST(l_linenumber * 1000 AS DOUBLE)) FILTER (WHERE l_returnflag = 'A'), 0.0) AS audio_bps,
       CAST(max(l_linenumber) AS INTEGER) AS width, CAST(NULL AS INTEGER) AS height FROM lineitem GROUP BY 1""",
)
def media_summary(spark, sf_dir):
    stream = F.struct(
        F.when(F.col("l_linenumber") % 3 > 0, F.col("l_quantity")).alias("duration"), F.when(F.col("l_returnflag") == "A", 2).otherwise(0).alias("channels"),
        (F.col("l_linenumber") * 1000).alias("bit_rate"), F.col("l_linenumber").alias("width"),
    )
    probes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(stream).alias("streams"))).alias("probe"))
    return lines.media_summary(probes, ["l_orderkey"], "probe")


@query("group_members", "SELECT p_name, n, array_to_string(m, ',') AS members FROM (SELECT p_name, count(*) AS n, list_sort(list(CAST(p_partkey AS BIGINT))) AS m FROM part GROUP BY 1) WHERE n >= 2")
def group_members(spark, sf_dir):
    got = lines.members(table(spark, sf_dir, "part"), "p_name", "p_partkey").orderBy(F.desc("n"), F.col("members")[0])
    return got.select("p_name", "n", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query("members_by_size", "SELECT p_brand, count(*) AS n, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_size DESC, p_partkey) AS members FROM part GROUP BY 1 HAVING count(*) >= 2")
def members_by_size(spark, sf_dir):
    got = lines.members(table(spark, sf_dir, "part"), "p_brand", "p_partkey", "p_size")
    return got.select("p_brand", "n", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query("limited_updates", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k <= 5")
def limited_updates(spark, sf_dir):
    return lines.limited(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 5).select("event_id")


@query("sorted_tags", "SELECT p_name, row_number() OVER (ORDER BY p_name) AS rank, CAST(size AS BIGINT) AS size, row_number() OVER (ORDER BY size, p_name) AS by_size FROM (SELECT p_name, sum(p_size) AS size FROM part GROUP BY 1)")
def sorted_tags(spark, sf_dir):
    from pyspark.sql.window import Window

    sums = table(spark, sf_dir, "part").groupBy("p_name").agg(F.sum("p_size").alias("size"))  # a few names
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("p_name"))).withColumn("by_size", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("size", "p_name")))


@query("distinct_tops", "SELECT DISTINCT source FROM documents")
def distinct_tops(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source").distinct()


@query("absolute_paths", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '/abs/' || doc_id ELSE source || '/' || lang || '/' || doc_id END AS path FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def absolute_paths(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("source IS NOT NULL AND lang IS NOT NULL")
    rel = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/abs/"), F.col("doc_id").cast("string"))).otherwise(F.concat_ws("/", "lang", F.col("doc_id").cast("string")))
    return d.withColumn("rel", rel).select("doc_id", lines.absolute("source", "rel").alias("path"))


@query("rows_per_key", "SELECT split_part(lower(p_name), ' ', 1) AS stem, string_agg(p_partkey || ':' || p_size, ',' ORDER BY p_partkey) AS rows FROM part GROUP BY 1")
def rows_per_key(spark, sf_dir):
    named = table(spark, sf_dir, "part").withColumn("stem", T.stem(F.regexp_replace("p_name", " ", ".")))
    return named.groupBy("stem").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_size"))), lambda r: F.concat_ws(":", r["p_partkey"].cast("string"), r["p_size"].cast("string"))), ",").alias("rows"))


@query("token_overlap", "SELECT p_partkey, CAST(len(list_intersect(string_split(lower(p_name), ' '), string_split(lower(p_type || ' ' || p_name), ' '))) AS INTEGER) AS shared FROM part")
def token_overlap(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.size(F.array_intersect(T.tokens(F.col("p_name")), T.tokens(F.concat_ws(" ", "p_type", "p_name")))).alias("shared"))


@query("inserts_and_updates", "SELECT doc_id, 'INSERT' AS what FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 'UPDATE' FROM documents WHERE n_chars % 2 = 0")
def inserts_and_updates(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    put = lambda cond, what: d.filter(cond).select("doc_id", F.lit(what).alias("what"))
    return put("doc_id % 5 = 0", "INSERT").unionByName(put("n_chars % 2 = 0", "UPDATE"))


@query("unmatched_new", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unmatched_new(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


_CANDIDATES = f"WITH {_H}, c AS ({_pairs_sql('front')}), b AS (SELECT doc_id, back FROM h WHERE doc_id % 11 <> 0)"


def _candidates(spark, sf_dir):
    h = _hashed(spark, sf_dir)
    return sim.hamming_pairs(h, "doc_id", "front", 10).select("a", "b"), h.filter("doc_id % 11 <> 0")


@query("verified_pairs", f"{_CANDIDATES} SELECT c.a, c.b, CAST(bit_count(xor(x.back, y.back)) AS INTEGER) AS bits FROM c JOIN b x ON c.a = x.doc_id JOIN b y ON c.b = y.doc_id WHERE bit_count(xor(x.back, y.back)) <= 10")
def verified_pairs(spark, sf_dir):
    pairs, hashes = _candidates(spark, sf_dir)
    return lines.verified(pairs, hashes, "doc_id", "back")


@query("duplicate_report", f"{_CANDIDATES} SELECT a || chr(10) || chr(9) || b || chr(10) AS line FROM c")
def duplicate_report(spark, sf_dir):
    return lines.duplicate_report(_candidates(spark, sf_dir)[0], "a", "b")


@query("no_duplicates", "SELECT '# No duplicates detected.' AS line")
def no_duplicates(spark, sf_dir):
    return lines.duplicate_report(_candidates(spark, sf_dir)[0].filter("a = b"), "a", "b")


@query(
    "lazy_changes",
    """SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN 'new' ELSE 'changed' END AS why FROM documents WHERE doc_id % 10 = 9 OR doc_id % 10 = 1 OR doc_id % 10 = 2""",
)
def lazy_changes(spark, sf_dir):
    """Of ten rows, one has grown, one has another text of the same size, one was touched only, and one is new."""
    k = F.col("doc_id") % 10
    now = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("size"), F.when(k.isin(2, 3), 1).otherwise(0).alias("time"), F.coalesce("text", F.lit("")).alias("text"))
    digest = F.md5("text")
    before = now.filter(k != 9).select("doc_id", F.when(k == 1, F.col("size") - 1).otherwise(F.col("size")).alias("size"), F.lit(0).alias("time"), F.when(k == 2, F.md5(F.concat("text", F.lit("x")))).otherwise(digest).alias("digest"))
    return lines.changed_lazily(now, before, "doc_id", "size", "time", digest)


_STATUS = "CASE WHEN doc_id % 7 = 0 THEN 'MISMATCH' WHEN doc_id % 7 = 1 THEN 'NEW' ELSE 'MATCH' END"


@query(
    "validation_report",
    f"""WITH s AS (SELECT {_STATUS} AS status, CAST(doc_id AS VARCHAR) AS line FROM documents), o AS (SELECT list_position(['MATCH', 'MISMATCH', 'MISSING', 'NEW'], status) AS section, * FROM s)
        SELECT CAST(section AS INTEGER) AS section, 1 AS "at", status || ': ' || line AS line FROM o UNION ALL SELECT DISTINCT CAST(section AS INTEGER), 0, '=== ' || status || ' ===' FROM o UNION ALL SELECT DISTINCT CAST(section AS INTEGER), 2, '' FROM o WHERE section < 4""",
)
def validation_report(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.expr(_STATUS).alias("status"), F.col("doc_id").cast("string").alias("line"))
    return lines.validation_report(rows, "status", "line")


@query("hottest_by_day", "SELECT user_id, CAST(ts AS DATE) AS day, max(CAST(floor(value) AS BIGINT)) AS hottest FROM events GROUP BY 1, 2")
def hottest_by_day(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max(F.floor("value")).alias("hottest"))


@query("lit_frames", "SELECT label, min(vec_id) AS vec_id FROM embeddings WHERE list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 1000)) >= 10 GROUP BY 1")
def lit_frames(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("pixels", F.transform("embedding", lambda x: x.cast("double") * 1000))
    return media.first_lit(e, ["label"], [F.col("vec_id")], "pixels").select("label", "vec_id")


@query("template_lines", "SELECT p_partkey, 'map<' || chr(10) || '  ' || p_brand || ',' || chr(10) || '  vec<' || p_size || '>' || chr(10) || '>' AS laid FROM part")
def template_lines(spark, sf_dir):
    kind = F.concat(F.lit("map<"), F.col("p_brand"), F.lit(", vec<"), F.col("p_size").cast("string"), F.lit(">>"))
    return table(spark, sf_dir, "part").select("p_partkey", T.laid_out(kind).alias("laid"))


@query("terminal_html", """SELECT p_partkey, '<span style="color:#00aa00;font-weight:bold">' || p_name || '</span> ' || p_brand AS html, substr(p_name || ' ' || p_brand, 1, 9) AS seen FROM part""")
def terminal_html(spark, sf_dir):
    shown = F.concat(F.lit("\x1b]0;title\x07\x1b[1;32m"), "p_name", F.lit("\x1b[0m\x1b[K "), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", T.ansi_html(shown).alias("html"), T.visible(F.concat(F.lit("\x1b[1;32m"), "p_name", F.lit("\x1b[0m "), "p_brand"), 9).alias("seen"))
