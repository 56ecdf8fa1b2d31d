"""Queries opN_<name> of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from platter.llm import byte_bpe, embedding_dedup, fingerprint, html_text, line_dedup, minhash_dedup, packing, pii, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_neighbours(_table(spark, sf_dir, "documents"))


def op2_toxicity_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages").select("page_id", "html"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup_embeddings(_table(spark, sf_dir, "embeddings"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_digest(_table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip_digest(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op9_url_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages")).drop("alias_component")


def op10_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_weighted_fingerprints": op1_weighted_fingerprints,
    "op2_toxicity_segments": op2_toxicity_segments,
    "op3_html_text": op3_html_text,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_line_dedup": op7_line_dedup,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_url_equivalence": op9_url_equivalence,
    "op10_pii_anchors": op10_pii_anchors,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP7_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      '{_UPPER}', '{_LOWER}') AS key
  FROM lines),
frequent AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.last AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

def _op9_dots(path: str) -> str:
    return f"""CASE WHEN {path} = '' THEN '/' WHEN NOT contains({path}, '/.') THEN {path} ELSE coalesce(nullif(
      list_reduce(list_prepend('', string_split(substr({path}, 2), '/')), lambda done, x:
        CASE x WHEN '..' THEN regexp_replace(done, '/[^/]*$', '') WHEN '.' THEN done ELSE done || '/' || x END)
      || CASE WHEN regexp_matches({path}, '/[.][.]?$') THEN '/' ELSE '' END, ''), '/') END"""


def _op9_value(name: str) -> str:
    pattern = rf"""(?i)[\s"''/]{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))"""
    return " || ".join(f"regexp_extract(tag, '{pattern}', {i})" for i in (1, 2, 3))


def _op9_decoded(text: str) -> str:
    for char, names in (("/", "sol|#0*47|#x0*2f"), (":", "colon|#0*58|#x0*3a"), ("=", "equals|#0*61|#x0*3d"), ("?", "quest|#0*63|#x0*3f"), ("&", "amp|#0*38|#x0*26")):
        text = f"regexp_replace({text}, '(?i)&(?:{names});', '{char}', 'g')"
    return text


def _op9_rule(path: str) -> str:
    return f"""CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with({path}, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with({path}, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with({path}, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with({path}, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with({path}, '/es/') THEN 'org/es/' END"""


_OP9_PARTS = f"""translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^#?]*([?][^#]*)?', 1) AS query"""
_OP9_BLOCKS = "('com/en/', 'example.net/de/8', 'org/es/')"

_OP9_SQL = rf"""
WITH RECURSIVE split AS (
  SELECT page_id, coalesce(strpos(url, '://') > 0, false) AS usable, coalesce(html, '') AS html,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (SELECT page_id, usable, html, {_OP9_PARTS} FROM split),
judged AS (
  SELECT *, host || {_op9_dots("path")} || query AS id, {_op9_rule("path")} AS rule FROM parts),
tags AS (
  SELECT id, host, path, rule, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^<>]*>')) AS tag FROM judged WHERE usable),
raw AS (
  SELECT id, host, path, rule, trim({_op9_decoded("CASE WHEN is_link THEN href ELSE fresh END")}) AS t FROM (
    SELECT *, starts_with(lower(tag), '<link') AS is_link, {_op9_value("href")} AS href,
           regexp_extract({_op9_value("content")}, '(?i)url\s*=\s*["'']?([^"'']*)', 1) AS fresh FROM tags)
  WHERE CASE WHEN is_link
    THEN regexp_matches(tag, '(?i)[\s"''/]rel\s*=\s*("[^"]*\bcanonical\b|''[^'']*\bcanonical\b|canonical\b)')
    ELSE regexp_matches(tag, '(?i)[\s"''/]http-equiv\s*=\s*["'']?\s*refresh\b') END),
aimed AS (
  SELECT id AS u, rule AS u_rule, CASE
    WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN substr(t, strpos(t, '://') + 3)
    WHEN starts_with(t, '//') THEN substr(t, 3)
    WHEN starts_with(t, '/') THEN host || t
    WHEN starts_with(t, '?') THEN host || path || t
    ELSE host || coalesce(nullif(regexp_replace(path, '[^/]*$', ''), ''), '/') || t END AS rest
  FROM raw WHERE t <> '' AND NOT starts_with(t, '#')
    AND (regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') OR NOT regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:'))),
ends AS (
  SELECT u, u_rule, host || {_op9_dots("path")} || query AS v, {_op9_rule("dotless")} AS v_rule
  FROM (SELECT *, {_op9_dots("path")} AS dotless FROM (SELECT u, u_rule, {_OP9_PARTS} FROM aimed))),
both_ways AS (
  SELECT u, v, u_rule AS rule FROM ends WHERE u <> v UNION SELECT v, u, v_rule FROM ends WHERE u <> v),
reach AS (
  SELECT u AS id FROM both_ways WHERE rule IN {_OP9_BLOCKS}
  UNION
  SELECT e.v FROM reach r JOIN both_ways e ON e.u = r.id)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN {_OP9_BLOCKS} THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN usable AND id IN (SELECT id FROM reach) THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""

ORACLE: dict[str, str] = {
    "op7_line_dedup": _OP7_SQL,
    "op9_url_equivalence": _OP9_SQL,
}
