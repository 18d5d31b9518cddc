"""Registered query of line dedup, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline.llm import lines


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), counts=True)
    return found.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


_SQL = f"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents
), o AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM d
), t AS (SELECT *, length(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS letters FROM o
), e AS (SELECT *, letters > 0 AS eligible FROM t
), a AS (
  SELECT line, any_value(letters) AS letters, min((doc_id, pos)) AS first, length(line) AS n, left(line, length(line) // 2) AS a, right(line, length(line) - length(line) // 2) AS b,
    left(line, (length(line) - 1) // 2) AS a1, right(line, (length(line) - 1) - (length(line) - 1) // 2) AS b1
  FROM e WHERE eligible GROUP BY line
), c AS (SELECT * FROM a WHERE letters >= {lines.MIN_CHARS}
), pairs AS (
  SELECT x.line AS x, y.line AS y FROM c x JOIN c y ON x.n = y.n AND x.a = y.a AND x.line < y.line
  UNION SELECT x.line, y.line FROM c x JOIN c y ON x.n = y.n AND x.b = y.b AND x.line < y.line
  UNION SELECT x.line, y.line FROM c x JOIN c y ON x.n = y.n - 1 AND x.a = y.a1
  UNION SELECT x.line, y.line FROM c x JOIN c y ON x.n = y.n - 1 AND x.b = y.b1
), links AS (SELECT x, y FROM pairs WHERE levenshtein(x, y) <= {lines.MAX_EDITS}
), late AS (
  SELECT DISTINCT CASE WHEN cx.first < cy.first THEN y ELSE x END AS line FROM links JOIN c cx ON cx.line = x JOIN c cy ON cy.line = y
), kept AS (
  SELECT e.doc_id, e.pos, e.line, NOT e.eligible OR (late.line IS NULL AND c.first = (e.doc_id, e.pos)) AS stays
  FROM e LEFT JOIN a c ON e.eligible AND c.line = e.line LEFT JOIN late ON e.eligible AND late.line = e.line
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE NOT stays)::BIGINT AS n_removed,
  length(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), ''))::BIGINT AS kept_chars,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '')) AS kept_sha256
FROM kept GROUP BY doc_id
"""

QUERIES = {"op3_line_dedup": op3_line_dedup}
ORACLES = {"op3_line_dedup": _SQL}
