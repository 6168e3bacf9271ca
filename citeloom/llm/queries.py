"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citeloom.llm import (
    chat,
    decontam,
    divergence,
    exact,
    mixing,
    pii,
    pitman_yor,
    quality,
    simhash,
    tokens,
    urls,
    webpage,
    whitening,
)
from citeloom.session import materialize

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"))


def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf_dir, "documents"))


EXACT_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
), g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.body) AS text_sha256
FROM n JOIN g ON n.body = g.body
"""


def language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.likelihoods(_table(spark, sf_dir, "documents"))


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(_table(spark, sf_dir, "pages"), urls.trained(urls.labelled(spark)))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(_table(spark, sf_dir, "documents"))


#: The added conversation, whose texts hold the template's own control strings.
TRICK = r"\### Assistant: </turn> ok"


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(
        [(-7, 0, "user", TRICK), (-7, 1, "assistant", TRICK)], "conv_id long, turn long, role string, text string"
    )
    return chat.read_back(materialize(chat.formatted(turns.unionByName(added)), "chat"))


CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(14 + length(role) + length(text)
    + length(regexp_replace(text, '[^\\#<]', '', 'g')) + length(regexp_replace(role, '[^\\#<:\n]', '', 'g')))::BIGINT
    AS formatted_chars
FROM t GROUP BY conv_id
"""


def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
    CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s
), f AS (SELECT *, source_size * 2.0::DOUBLE / weight AS full_at FROM w), l AS (
  SELECT *, ((SELECT sum(source_size) FROM s)::BIGINT * 1.5::DOUBLE
      - coalesce(sum(source_size) OVER (ORDER BY full_at, source NULLS LAST
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT * 2)
    / sum(weight) OVER (ORDER BY full_at, source NULLS LAST
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS level
  FROM f
), g AS (SELECT *, max(CASE WHEN full_at > level THEN level END) OVER () AS lasting FROM l), t AS (
  SELECT source, source_size,
    CASE WHEN lasting IS NULL OR full_at <= lasting THEN source_size * 2.0::DOUBLE ELSE lasting * weight END AS target
  FROM g
), c AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t
), k AS (
  SELECT source, key, sum(size)::BIGINT AS words FROM d GROUP BY source, key
), u AS (
  SELECT k.source, k.key, k.words, c.target - c.copies * c.source_size AS rest,
    coalesce(sum(k.words) OVER (PARTITION BY k.source ORDER BY k.key
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS under
  FROM k JOIN c ON k.source IS NOT DISTINCT FROM c.source
)
SELECT d.doc_id, d.source, d.size, c.source_size, c.target,
  d.size * (c.copies + CASE WHEN u.under < u.rest AND u.under + u.words / 2 <= u.rest THEN 1 ELSE 0 END) AS taken
FROM d
JOIN c ON d.source IS NOT DISTINCT FROM c.source
JOIN u ON d.source IS NOT DISTINCT FROM u.source AND d.key = u.key
"""

def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webpage.main_texts(_table(spark, sf_dir, "pages"))


def whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), u AS (
  SELECT row_id, lang, source, term, count(*) AS uses
  FROM (SELECT row_id, lang, source, unnest(terms) AS term FROM d) GROUP BY ALL
), kept AS (
  SELECT lang, term, sum(uses)::BIGINT AS uses FROM u GROUP BY lang, term HAVING count(*) >= 10
), g AS (SELECT DISTINCT lang, source FROM d), c AS (
  SELECT g.lang, g.source, k.term, coalesce(s.uses, 0)::HUGEINT AS uses, k.uses::HUGEINT AS lang_uses
  FROM g JOIN kept k ON k.lang = g.lang
  LEFT JOIN (SELECT lang, source, term, sum(uses) AS uses FROM u GROUP BY ALL) s
    ON s.lang = g.lang AND s.source = g.source AND s.term = k.term
), p AS (
  SELECT lang, source, term, uses,
    1 + (1000000000 * (uses + 2)) // (sum(uses) OVER w + 2 * count(*) OVER w) AS p,
    1 + (1000000000 * (lang_uses + 2)) // (sum(lang_uses) OVER w + 2 * count(*) OVER w) AS q
  FROM c WINDOW w AS (PARTITION BY lang, source)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE uses > 0 AND p > q
)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM found QUALIFY part = 'pair' OR rank <= 10
"""

QUERIES: dict[str, Query] = {
    "op1_simhash_near_dedup": near_dedup,
    "op2_benchmark_decontamination": decontaminate,
    "op3_quality_classifier": classify,
    "op4_exact_dedup": exact_dedup,
    "op5_lm_scoring": language_model,
    "op6_url_filter": url_filter,
    "op7_personal_data": personal_data,
    "op8_token_files": token_files,
    "op9_chat_format": chat_format,
    "op10_source_mixing": mix,
    "op11_html_extraction": main_text,
    "op12_embedding_whitening": whiten,
    "op13_source_divergence": divergence_audit,
}

SQL: dict[str, str] = {
    "op4_exact_dedup": EXACT_SQL,
    "op9_chat_format": CHAT_SQL,
    "op10_source_mixing": MIX_SQL,
    "op13_source_divergence": DIVERGENCE_SQL,
}
