"""Registered query of the quality rules, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline.llm import rules


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.apply_policy(rules.ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), rules.STRICT)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed").bitwiseAND(F.lit(rules.BASE.mask)) != 0).alias("base_failed"), "kept",
        "n_lines", "n_capitals", "n_exclamations", "failed",
    )


_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, rid, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
         [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM d
), tri AS (
  SELECT rid, i, words[i] || chr(32) || words[i + 1] || chr(32) || words[i + 2] AS g
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri) WHERE c >= 2
), covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    (length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')))::BIGINT AS n_capitals,
    (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclamations
  FROM w LEFT JOIN covered c USING (rid)
), f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN 10 * n_dup_lines > 6 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 12 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 2 * n_capitals > word_chars THEN 32 ELSE 0 END
    + CASE WHEN 10 * n_exclamations > 3 * n_words THEN 64 ELSE 0 END)::BIGINT AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, failed = 0 AS kept,
  n_lines, n_capitals, n_exclamations, failed
FROM f
"""


def rules_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each rule of the strict policy: documents that fail it, and those that it alone rejects."""
    return rules.ablations(rules.ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), rules.STRICT)


_ABLATION = "WITH l AS (" + _SQL + ") " + " UNION ALL ".join(
    f"SELECT '{rules.STRICT.version}' AS policy, '{r}' AS rule, count(*) FILTER (WHERE failed & {1 << rules.BITS[r]} <> 0)::BIGINT AS failed, count(*) FILTER (WHERE failed = {1 << rules.BITS[r]})::BIGINT AS only_this FROM l"
    for r in rules.STRICT.rules
)

QUERIES = {"op6_quality_rules": op6_quality_rules, "rules_ablation": rules_ablation}
ORACLES = {"op6_quality_rules": _SQL, "rules_ablation": _ABLATION}
