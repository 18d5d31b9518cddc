"""Registered query of the license scan, and its SQL: the templates as regular expressions over words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reefline.llm import licenses


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.verdicts(licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _places(phrase: str) -> str:
    words = licenses.words_of(phrase)
    stands = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words, 1))
    return f"[i for i in range(0, len(w)) if {stands}]"


_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), p AS (
  SELECT doc_id, w, array_to_string(w, ' ') || ' ' AS t, {", ".join(f"{_places(p)} AS p{k}" for k, (_, p) in enumerate(licenses.PHRASES))} FROM d
), q AS (
  SELECT doc_id, w, {" || ".join(f"p{k}" for k in range(len(licenses.PHRASES)))} AS places,
    [x for x in [{", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{x}' END" for k, (x, _) in enumerate(licenses.PHRASES))}] if x IS NOT NULL] AS base,
    [x for x in [{", ".join(f"CASE WHEN regexp_matches(t, '{licenses.pattern(x)}') THEN '{label}' END" for label, x in licenses.TEMPLATES)}] if x IS NOT NULL] AS own
  FROM p
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
  array_to_string(list_sort(list_distinct(base)), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, own))), ',') AS labels,
  CASE WHEN len(own) > 0 THEN 1.0 WHEN len(places) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM q
"""

QUERIES = {"op11_license_scan": op11_license_scan}
ORACLES = {"op11_license_scan": _SQL}
