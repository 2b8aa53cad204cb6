"""The queries of the ten operators and of the pipeline, over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import capture_index, decontamination, exact_dedup, mixing, pii_surrogates, secret_scan, simhash, substring_dedup, tool_calls, toxicity

_NORMALISED = r"' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) || ' '"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.linked_conversations(_table(spark, sf_dir, "conversations"), tool_calls.SCHEMAS)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.document_secrets(_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_surrogates.surrogate_texts(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"))


def op10_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return capture_index.captures_of(capture_index.build(pages), pages)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontamination, op2_tool_calls, op3_secrets, op4_substring_dedup, op5_exact_dedup, op6_toxicity, op7_pii, op8_mixing, op9_simhash, op10_captures)}

SQL: dict[str, str] = {
    "op1_decontamination": rf"""
WITH items AS (SELECT item_id, string_split(trim(n), ' ') AS w FROM (SELECT item_id, {_NORMALISED} AS n FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL)),
grams AS (SELECT DISTINCT item_id, ' ' || array_to_string(list_slice(w, i, i + {decontamination.NGRAM} - 1), ' ') || ' ' AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {decontamination.NGRAM} + 1) + 1)) AS i FROM items WHERE len(w) >= {decontamination.LEAST_WORDS})),
texts AS (SELECT doc_id, {_NORMALISED} AS n FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
SELECT doc_id, item_id, count(DISTINCT gram) AS n_grams FROM texts JOIN grams ON contains(n, gram) GROUP BY doc_id, item_id""",
    "op5_exact_dedup": """
SELECT DISTINCT doc_id, keep_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text), text) AS keep_id FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL) WHERE doc_id <> keep_id""",
    "op10_captures": r"""
WITH p AS (SELECT page_id, md5(coalesce(html, '')) AS digest, length(coalesce(html, '')) AS n_chars, lower(regexp_extract(url, '{url}', 1)) AS host, regexp_extract(url, '{url}', 2) AS port, regexp_extract(url, '{url}', 3) AS path, regexp_extract(url, '{url}', 4) AS query
  FROM pages WHERE url IS NOT NULL AND page_id IS NOT NULL)
SELECT array_to_string(list_reverse(string_split(host, '.')), ',') || CASE WHEN port IN (':80', ':443', ':') THEN '' ELSE port END || ')' || CASE WHEN path = '' THEN '/' ELSE path END || query AS urlkey, page_id, digest, n_chars FROM p""".replace("{url}", capture_index.URL),
}
