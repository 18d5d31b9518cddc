"""Registered query of the Merkle manifest, and its SQL: levels by recursion, then each leaf's way up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline.llm import manifest


def tampered(doc_id: Column) -> Column:
    """Rows whose proof the contract tampers with."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.audit(manifest.build(spark.read.parquet(f"{sf_dir}/documents.parquet"), tampered))


_CRC = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT for x in string_split(doc_id::VARCHAR, '')]),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)))"""


def _leaf(n_chars: str) -> str:
    part = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    return "sha256(" + " || ".join(part(f"({n_chars})" if c == "n_chars" else c) for c in manifest.FIELDS) + ")"


_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_leaf("n_chars + 1")} END AS other FROM documents
), leaves AS (
  SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d
), lev(lang, lv, i, h, n) AS (
  SELECT lang, 0, i, leaf, n FROM leaves
  UNION ALL
  SELECT lang, lv + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM lev WHERE n > 1 GROUP BY lang, lv, i // 2, n
), langs AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS q, count(*) OVER () AS n FROM lev WHERE n = 1
), top(lv, i, h, n) AS (
  SELECT 0, q, subroot, n FROM langs
  UNION ALL
  SELECT lv + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY lv, i // 2, n
), walk(rid, lang, lv, i, n, cur, sides) AS (
  SELECT rid, lang, 0, i, n, coalesce(other, leaf), '' FROM leaves
  UNION ALL
  SELECT w.rid, w.lang, w.lv + 1, w.i // 2, (w.n + 1) // 2, sha256(CASE WHEN w.i % 2 = 1 THEN s.h || w.cur ELSE w.cur || coalesce(s.h, '') END), w.sides || coalesce(s.h, '')
  FROM walk w LEFT JOIN lev s ON s.lang IS NOT DISTINCT FROM w.lang AND s.lv = w.lv AND s.i = xor(w.i, 1) WHERE w.n > 1
), rise(rid, subroot, lv, i, n, cur, sides) AS (
  SELECT w.rid, g.subroot, 0, g.q, g.n, w.cur, w.sides FROM walk w JOIN langs g ON g.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
  UNION ALL
  SELECT w.rid, w.subroot, w.lv + 1, w.i // 2, (w.n + 1) // 2, sha256(CASE WHEN w.i % 2 = 1 THEN s.h || w.cur ELSE w.cur || coalesce(s.h, '') END), w.sides || coalesce(s.h, '')
  FROM rise w LEFT JOIN top s ON s.lv = w.lv AND s.i = xor(w.i, 1) WHERE w.n > 1
)
SELECT l.doc_id, l.leaf, r.subroot, t.h AS root, sha256(r.sides) AS proof_sha256, r.cur AS folded_root, r.cur = t.h AS verified
FROM leaves l JOIN rise r ON r.rid = l.rid AND r.n = 1 JOIN top t ON t.n = 1
"""

QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
ORACLES = {"op12_merkle_manifest": _SQL}
