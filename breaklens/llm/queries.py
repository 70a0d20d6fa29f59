"""Registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breaklens.llm import bpe, collocation, fingerprint, minhash, mixing, negatives, quality, secrets, tokenfile, toolcalls, topk, warc
from breaklens.llm.linededup import dedup_lines
from breaklens.sources.tables import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


ANSWER = {
    "answer": {
        "type": "object",
        "required": ["question", "words"],
        "additionalProperties": False,
        "properties": {"question": {"type": "string", "minLength": 1}, "words": {"type": "integer", "minimum": 3}},
    }
}


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn is a call of the tool `answer`, the reply in the next turn its result.

    Call k of a conversation builds on call k // 2 (by turn), which gives a tree to put in order.
    """
    turns = table(spark, sf_dir, "conversations")
    name = F.concat_ws("-", "conv_id", "turn")
    before = F.floor((F.col("turn") / 2) / 2) * 2
    arguments = F.to_json(F.struct(F.col("text").alias("question"), F.size(F.split("text", " ")).alias("words")))
    call = F.struct(
        name.alias("id"),
        F.lit("answer").alias("name"),
        arguments.alias("arguments"),
        F.when(before < F.col("turn"), F.array(F.concat_ws("-", "conv_id", before))).otherwise(F.array().cast("array<string>")).alias("after"),
    )
    asks, replies = F.col("role") == "user", F.col("role") == "assistant"
    messages = turns.select(
        "conv_id",
        "turn",
        "text",
        F.when(asks, F.array(call)).alias("calls"),
        F.when(replies, F.concat_ws("-", "conv_id", F.col("turn") - 1)).alias("result_of"),
    )
    return toolcalls.link_tool_calls(messages, ANSWER)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality_rules(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of the archive of all pages against a replica in which some records are damaged."""
    records = warc.archive(table(spark, sf_dir, "pages"))
    return warc.audit(records, warc.with_damage(records)).withColumnRenamed("_id", "page_id")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.document_fingerprints(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what is left of its text."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two and three words of every language."""
    return collocation.collocations(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector."""
    return negatives.mined(table(spark, sf_dir, "embeddings"))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 rows of highest inner product of every twentieth vector."""
    return topk.nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe, op2_token_files, op3_tool_calls, op4_minhash, op5_quality,
        op6_warc_fixity, op7_fingerprints, op8_line_dedup, op9_secrets, op10_mixing,
        op11_collocations, op12_hard_negatives, op13_exact_topk,
    )
}

_SETS = r"""words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i : i + 4] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id)"""
_WHOLE = """vectors AS (
  SELECT vec_id, {label} AS label, [floor({scale} * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0{extra})"""
ORACLE = {
    "op4_minhash": f"""WITH RECURSIVE {_SETS},
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach(u, v) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least.v AS component_id, d.doc_id = least.v AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT u, min(v) AS v FROM reach GROUP BY u) least ON least.u = d.doc_id""",
    "op11_collocations": r"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS i FROM words, (SELECT unnest([1, 2, 3]) AS k)) GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a FROM grams WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM candidates),
scored AS (
  SELECT c.lang, c.k, c.phrase, a, cut, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.k = cut AND x.phrase = array_to_string(w[1:cut], ' ')
  JOIN grams y ON y.lang = c.lang AND y.k = c.k - cut AND y.phrase = array_to_string(w[cut + 1 :], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, inner_phrase, max(a) AS a FROM (
    SELECT lang, a, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS inner_phrase
    FROM candidates WHERE k = 3) GROUP BY lang, inner_phrase),
ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, phrase) AS rank
  FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.inner_phrase = b.phrase WHERE o.a IS NULL OR 100 * o.a < 50 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
    "op12_hard_negatives": f"""WITH {_WHOLE.format(scale=256, label="CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END", extra=" AND label IS NOT NULL")},
scores AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT * FROM scores WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INT AS rank,
       s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label
 AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10""",
    "op13_exact_topk": f"""WITH {_WHOLE.format(scale=64, label="0", extra="")}
SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id)::INT AS rank,
       c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
QUALIFY rank <= 20""",
}
