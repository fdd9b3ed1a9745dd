"""The registered corpus queries: thin callers of the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, hmm, html, langid, licenses, media, neardup, packing, quality, warc
from .common import table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_packing": op2_packing,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_language_id": op4_language_id,
    "op5_media_columns": op5_media_columns,
    "op6_quality_rules": op6_quality_rules,
    "op7_warc": op7_warc,
    "op8_license_scan": op8_license_scan,
    "op9_hmm_scores": op9_hmm_scores,
    "op10_near_duplicates": op10_near_duplicates,
}

_STOP_FORMS = ", ".join(f"'{w}'" for w in quality.STOP_FORMS)

OP6_SQL = f"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), parts AS (
  SELECT rid, doc_id, t,
    regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM base
), grams AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 2)) AS i FROM parts WHERE len(w) >= 3)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT i + o) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS s(o) GROUP BY rid
), measured AS (
  SELECT doc_id,
    CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_shouts,
    CAST(length(regexp_replace(t, '[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]', '', 'g')) AS BIGINT) AS n_letters,
    CAST(len(list_filter(w, lambda x: x IN ({_STOP_FORMS}))) AS BIGINT) AS n_stop_words,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM parts LEFT JOIN covered USING (rid)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
)
SELECT *, NOT base_failed
  AND 10 * word_chars BETWEEN 25 * n_words AND 140 * n_words
  AND 100 * n_symbols <= 10 * n_words
  AND 100 * n_shouts <= 30 * n_words
  AND 100 * n_stop_words >= 4 * n_words
  AND 100 * n_letters >= 60 * word_chars
  AND 100 * n_lines <= 34 * n_words
  AND 100 * n_dup_lines <= 50 * n_lines AS kept
FROM judged
"""

#: Base32 has no function in DuckDB: the hex digits are regrouped by five bits.
OP7_SQL = """
WITH captures AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages
), bits AS (
  SELECT page_id, n, h, array_to_string(list_transform(range(1, 41),
    lambda i: format('{:04b}', instr('0123456789abcdef', substr(h, i, 1)) - 1)), '') AS b
  FROM captures
), digests AS (
  SELECT page_id, n, h, array_to_string(list_transform(range(0, 32),
    lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + list_sum(list_transform(range(0, 5), lambda j: CAST(substr(b, 5 * i + j + 1, 1) AS INTEGER) * (16 >> j)))::INTEGER, 1)), '') AS d
  FROM bits
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM digests
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM firsts
"""

ORACLE_SQL: dict[str, str] = {"op6_quality_rules": OP6_SQL, "op7_warc": OP7_SQL}
