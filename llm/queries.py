"""Queries over the driver's tables, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from llm.collocations import COLLOCATIONS_SQL
from llm.license_scan import license_sql
from llm.spelling import SPELLING_SQL
from llm.url_filter import url_filter_sql

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.exact_dedup import exact_dedup

    return exact_dedup(_documents(spark, sf_dir))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents
), r AS (
  SELECT doc_id, h,
         first_value(doc_id) OVER (PARTITION BY h ORDER BY length(text) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY h) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM r
"""

def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.packing import best_fit_pack

    return best_fit_pack(_documents(spark, sf_dir))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.quality import quality_rules

    return quality_rules(_documents(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.substring_dedup import remove_repeated_passages

    return remove_repeated_passages(_documents(spark, sf_dir), with_text=False)


def op3_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.preference import format_preferences, pairs_of_conversations

    return format_preferences(pairs_of_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP3_SQL = r"""
WITH r AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), l AS (
  SELECT conv_id, max(CASE WHEN role = 'assistant' THEN k END) AS last FROM r GROUP BY conv_id
), p AS (
  SELECT conv_id, lead(conv_id) OVER (PARTITION BY floor(conv_id / 1000), role, text ORDER BY conv_id) AS alike,
         lead(conv_id) OVER (PARTITION BY floor(conv_id / 1000) ORDER BY conv_id) AS next
  FROM r WHERE k = 1
), m AS (
  SELECT p.conv_id, coalesce(alike, next) AS partner, a.last, b.last AS others,
         alike IS NULL AND a.last IS NOT NULL AND b.last IS NOT NULL AS takes
  FROM p JOIN l a ON a.conv_id = p.conv_id LEFT JOIN l b ON b.conv_id = coalesce(alike, next)
), rejected AS (
  SELECT m.conv_id, r.k, r.role, r.text FROM m JOIN r ON r.conv_id = m.partner WHERE NOT takes
  UNION ALL SELECT m.conv_id, r.k, CASE WHEN r.k = m.last THEN o.role ELSE r.role END, CASE WHEN r.k = m.last THEN o.text ELSE r.text END
  FROM m JOIN r ON r.conv_id = m.conv_id JOIN r o ON o.conv_id = m.partner AND o.k = m.others WHERE takes
), c AS (  -- both conversations turn by turn, and where they part
  SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.k, b.k) AS k,
         a.k IS NULL OR b.k IS NULL OR a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text AS differs
  FROM r a FULL JOIN rejected b ON a.conv_id = b.conv_id AND a.k = b.k
), n AS (
  SELECT conv_id, coalesce(min(CASE WHEN differs THEN k END) - 1, max(k)) AS n FROM c GROUP BY conv_id
), t AS (
  SELECT side, x.conv_id, k, x.k <= n.n AS shared, role = 'assistant' AS trained,
         '<|im_start|>' || replace(coalesce(role, ''), '<|', '< |') || chr(10) AS head, replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10) AS body
  FROM (SELECT 'a' AS side, conv_id, k, role, text FROM r UNION ALL SELECT 'b', conv_id, k, role, text FROM rejected) x JOIN n USING (conv_id)
), s AS (
  SELECT conv_id, side, shared, string_agg(head || body, '' ORDER BY k) AS s, bool_or(coalesce(trained, false)) AS trained,
         string_agg(length(head) || ':0 ' || length(body) || CASE WHEN trained THEN ':1' ELSE ':0' END, ' ' ORDER BY k) AS mask
  FROM t GROUP BY ALL
)
SELECT n.conv_id AS pair_id, n.n AS n_prompt_turns, coalesce(p.s, '') AS prompt, coalesce(a.s, '') AS chosen, coalesce(a.mask, '') AS chosen_mask,
       coalesce(b.s, '') AS rejected, coalesce(b.mask, '') AS rejected_mask, coalesce(a.trained AND b.trained, false) AS usable
FROM n LEFT JOIN s p ON p.conv_id = n.conv_id AND p.side = 'a' AND p.shared
LEFT JOIN s a ON a.conv_id = n.conv_id AND a.side = 'a' AND NOT a.shared LEFT JOIN s b ON b.conv_id = n.conv_id AND b.side = 'b' AND NOT b.shared
"""


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.sentencepiece_codec import encode_documents

    return encode_documents(_documents(spark, sf_dir), with_ids=False)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.license_scan import scan_licenses

    return scan_licenses(_documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.toxicity import score_toxicity

    return score_toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.jaccard_join import jaccard_components

    return jaccard_components(_documents(spark, sf_dir), shingle=4, percent=85)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.suffix_dedup import remove_repeated_bytes

    return remove_repeated_bytes(_documents(spark, sf_dir), with_text=False)


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.url_filter import filter_urls, standard_rules

    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), standard_rules(spark))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.spelling import spelling_variants

    return spelling_variants(_documents(spark, sf_dir))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from llm.collocations import collocations

    return collocations(_documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_substring_dedup": op2_substring_dedup,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op3_preference_formatting": op3_preference_formatting,
    "op5_sentencepiece": op5_sentencepiece,
    "op7_license_scan": op7_license_scan,
    "op6_toxicity": op6_toxicity,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_url_filter": op11_url_filter,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {
    "op3_preference_formatting": OP3_SQL,
    "op7_license_scan": license_sql(),
    "op9_exact_dedup": OP9_SQL,
    "op11_url_filter": url_filter_sql(),
    "op12_spelling_variants": SPELLING_SQL,
    "op13_collocations": COLLOCATIONS_SQL,
}
