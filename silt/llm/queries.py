"""The opN_<name> queries: each applies its operator to the whole table and derives the columns that are asked for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silt.llm import bpe, cws, dialogue, licenses, lines, lm, minhash, packing, phrases, rules, secrets, suffix, toxicity
from silt.llm.common import documents, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@query
def op2_secret_ownership(spark, sf_dir):
    found = secrets.scan(documents(spark, sf_dir), "doc_id", "text", owner="source", repo="lang")
    kinds = [F.expr(f"CAST(size(filter(base, s -> s.order = {k})) AS bigint)").alias(n) for k, n in enumerate(("n_assign", "n_access", "n_hex"))]
    return found.select("doc_id", *kinds, sha(secrets.listed("base")).alias("base_sha256"), secrets.listed("spans").alias("spans"), "n_live", "n_example", "most_owners", "most_repos")


@query
def op5_bpe_codec(spark, sf_dir):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ids = bpe.encode(documents(spark, sf_dir), "doc_id", "text", path, pattern)
    back = bpe.decode(ids, "doc_id", path, pattern)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op6_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    fold = lambda c: F.crc32(c.cast("string").cast("binary")) % 5
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "text", "toxic", lambda c: fold(c) != 0)
    scored = toxicity.score(docs, ["doc_id"], "text", model)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op8_quality_rules(spark, sf_dir):
    measured = stored(rules.measure(documents(spark, sf_dir), ["doc_id"], "text"), "measures")
    learnt = rules.fit(measured, spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    return measured.select("doc_id", *rules.COUNTS[:5], rules.base_failed().alias("base_failed"), rules.verdict(learnt).alias("kept"))


@query
def op9_best_fit(spark, sf_dir):
    return packing.pack_documents(documents(spark, sf_dir), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@query
def op3_license_digest(spark, sf_dir):
    return licenses.match(documents(spark, sf_dir), "doc_id", "text")


ORACLES["op3_license_digest"] = licenses.oracle_sql()


@query
def op7_weighted_sampling(spark, sf_dir):
    return cws.fingerprints(documents(spark, sf_dir), "doc_id", "text")


@query
def op1_masked_scores(spark, sf_dir):
    return lm.pseudo_likelihood(documents(spark, sf_dir), "doc_id", "text")


@query
def op4_prob_minhash(spark, sf_dir):
    return minhash.near_duplicates(documents(spark, sf_dir), "doc_id", "text")


@query
def op10_suffix_repeats(spark, sf_dir):
    return suffix.repeats(documents(spark, sf_dir), "doc_id", "text")


@query
def op11_line_dedup(spark, sf_dir):
    return lines.deduplicated(documents(spark, sf_dir), "doc_id", "text")


ORACLES["op11_line_dedup"] = r"""
WITH lines AS (
  SELECT r, doc_id, pos, line, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
        FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
again AS (SELECT k, min(doc_id) AS least FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT r, lines.doc_id, pos, line, coalesce(lines.doc_id <> least, false) AS lost FROM lines LEFT JOIN again ON lines.k = again.k)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE lost) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""


@query
def op12_conversation_repair(spark, sf_dir):
    rows = dialogue.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "role", "text")
    return dialogue.report(rows, "conv_id", "turn", "role", "text", "present")


@query
def op13_collocations(spark, sf_dir):
    return phrases.collocations(documents(spark, sf_dir), "text", "lang")


ORACLES["op13_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\v\f\r]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT lang, s, len(s) AS m, count(*) AS f FROM (SELECT lang, unnest([w[i:i], CASE WHEN i + 1 <= len(w) THEN w[i:i+1] END, CASE WHEN i + 2 <= len(w) THEN w[i:i+2] END]) AS s FROM starts) WHERE s IS NOT NULL GROUP BY lang, s),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE m = 1 GROUP BY lang),
often AS (SELECT * FROM grams WHERE f >= 10),
cuts AS (SELECT lang, s, m, f, unnest(range(1, m)) AS k FROM often WHERE m > 1),
scored AS (
  SELECT c.lang, c.s, c.m, c.f AS a, k, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN often x ON x.lang = c.lang AND x.s = c.s[1:k] JOIN often y ON y.lang = c.lang AND y.s = c.s[k+1:c.m]),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, s ORDER BY score, k) = 1),
inner_ AS (SELECT lang, p, max(f) AS f FROM (SELECT lang, f, unnest([s[1:2], s[2:3]]) AS p FROM often WHERE m = 3) GROUP BY lang, p),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.p = b.s WHERE i.f IS NULL OR 100 * i.f < 50 * b.a),
ranked AS (SELECT lang, array_to_string(s, ' ') AS phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(s, ' ')) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
