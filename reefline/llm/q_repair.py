"""Registered query of conversation repair on damaged conversations, and its SQL: the programme by recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline.llm import repair

EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage; nulls are one space."""
    put = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(put("conv_id"), F.lit(":"), put("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(put("text"), "[.!?]", "")).otherwise(put("text"))
    told = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(put("role")).alias("role"), text.alias("text"), kind.alias("_kind")).where("_kind <> 0")
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    return told.select("conv_id", "turn", "role", "text", copies.alias("_copy")).drop("_copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = repair.repair(damaged(own)).withColumnRenamed("conv_id", "_conv")
    whole = own.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return whole.select("conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256"))


_CRC = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT for x in string_split(k, '')]),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)))"""
_FAR = 1 << 40
# Costs from each state after a kept row; c is the row's initial.
_KEPT = {0: "CASE c WHEN 's' THEN b.v1 WHEN 'u' THEN b.v2 ELSE {far} END", 1: "CASE c WHEN 'u' THEN b.v2 ELSE {far} END", 2: "CASE c WHEN 'a' THEN b.v3 ELSE {far} END", 3: "CASE c WHEN 'u' THEN b.v2 ELSE {far} END"}
_DUE = {0: 2, 1: 2, 2: 3, 3: 2}
_ROW = ", ".join(f"CASE WHEN kill THEN 3 + b.v{s} ELSE least(3 + b.v{s}, cut + 2 + b.v{_DUE[s]}, cut + {_KEPT[s].format(far=_FAR)}) END AS w{s}" for s in range(4))
_INS = "least(w0, 2 + w2, 4 + w3) AS v0, least(w1, 2 + w2, 4 + w3) AS v1, least(w2, 2 + w3) AS v2, least(w3, 2 + w2) AS v3"
_AT = lambda v: f"(CASE s WHEN 0 THEN {v}0 WHEN 1 THEN {v}1 WHEN 2 THEN {v}2 ELSE {v}3 END)"
_NEXT = "(CASE s WHEN 2 THEN 3 ELSE 2 END)"
_SQL = f"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), kinds AS (SELECT *, {_CRC} % 20 AS kind FROM src
), dmg AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0
), r AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS c, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS body,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS before
  FROM dmg
), f AS (
  SELECT *, CASE WHEN body = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM r
), g AS (SELECT conv_id, i, n, c, role, text, fault IN ('b', 'd') AS kill, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS cut FROM f
), back(conv_id, i, v0, v1, v2, v3) AS (
  SELECT conv_id, n + 1, 0::BIGINT, 4::BIGINT, 2::BIGINT, 0::BIGINT FROM g WHERE i = 1
  UNION ALL
  SELECT conv_id, i, {_INS} FROM (SELECT g.conv_id, g.i, {_ROW} FROM back b JOIN g ON g.conv_id IS NOT DISTINCT FROM b.conv_id AND g.i = b.i - 1)
), walk(conv_id, i, s, audit, said) AS (
  SELECT conv_id, 1::BIGINT, 0, '', []::VARCHAR[] FROM g WHERE i = 1
  UNION ALL
  SELECT conv_id, CASE letter WHEN 'I' THEN i ELSE i + 1 END,
    CASE letter WHEN 'D' THEN s WHEN 'K' THEN CASE c WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE {_NEXT} END, audit || letter,
    CASE letter WHEN 'D' THEN said WHEN 'K' THEN list_append(said, role || ':' || text)
      ELSE list_append(said, CASE {_NEXT} WHEN 2 THEN 'user:' ELSE 'assistant:' END || CASE letter WHEN 'R' THEN text ELSE '' END) END
  FROM (
    SELECT w.*, g.c, g.role, g.text, CASE WHEN a.i IS NOT NULL AND {_AT("b.v")} = 3 + {_AT("a.v")} THEN 'D'
        WHEN {_AT("b.v")} = 2 + CASE {_NEXT} WHEN 2 THEN b.v2 ELSE b.v3 END THEN 'I'
        WHEN {_AT("b.v")} = g.cut + CASE WHEN g.kill THEN {_FAR} WHEN g.c = 's' AND s = 0 THEN a.v1 WHEN g.c = 'u' AND s <> 2 THEN a.v2 WHEN g.c = 'a' AND s = 2 THEN a.v3 ELSE {_FAR} END THEN 'K'
        ELSE 'R' END AS letter
    FROM walk w JOIN back b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.i = w.i LEFT JOIN back a ON a.conv_id IS NOT DISTINCT FROM w.conv_id AND a.i = w.i + 1
      LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i
    WHERE g.i IS NOT NULL OR s IN (1, 2)
  )
), ends AS (
  SELECT w.conv_id, w.audit, sha256(array_to_string(w.said, chr(10))) AS repaired_sha256
  FROM walk w JOIN (SELECT conv_id, max(n) AS n FROM g GROUP BY conv_id) x ON x.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i = x.n + 1 AND w.s IN (0, 3)
), sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 'b')::BIGINT AS blank, count(*) FILTER (WHERE fault = 'd')::BIGINT AS duplicate,
    count(*) FILTER (WHERE fault = 't')::BIGINT AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal
  FROM f GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(b.v0, 0)::BIGINT AS cost, coalesce(e.audit, '') AS audit, coalesce(e.repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
  LEFT JOIN back b ON b.conv_id IS NOT DISTINCT FROM o.conv_id AND b.i = 1
"""

QUERIES = {"op13_conversation_repair": op13_conversation_repair}
ORACLES = {"op13_conversation_repair": _SQL}
