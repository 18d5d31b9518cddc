"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` evaluates every rule once for each document and stores the measurements next to one
bigint whose bit r is set where rule r failed. ``apply_policy`` turns a ledger into verdicts under
a named, versioned policy (a mask of rules) without touching a text again, and ``ablations`` counts
by bitwise aggregation what each rule of a policy rejects alone.

Defined cases: a null or empty text has no words and fails ``few_words``; a null ``doc_id`` is kept
as null; repeated rows give repeated ledger rows; extra input columns are ignored, whatever their
names; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rule names in the order of their bits, each with the condition under which a document fails.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "10 * n_dup_lines > 6 * n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 12 * n_words"),
    ("capitals", "2 * n_capitals > word_chars"),
    ("exclamations", "10 * n_exclamations > 3 * n_words"),
)
BITS = {name: i for i, (name, _) in enumerate(RULES)}

#: White space as the rules see it.
SPACE = " \t\n\x0b\x0c\r"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_exclamations")


@dataclass(frozen=True)
class Policy:
    """A document is rejected if any rule named here failed."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << BITS[r] for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_words"))
STRICT = Policy("strict-1", tuple(BITS))


def _let(value: F.Column, then: Callable[[F.Column], F.Column]) -> F.Column:
    """``then`` of a value that is worked out once, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _windows(words: F.Column) -> F.Column:
    """A 64-bit hash of each three-word window."""
    return F.when(
        F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    ).otherwise(F.array().cast("array<bigint>"))


def _covered(hashes: F.Column) -> F.Column:
    """Words inside a window that occurs twice or more in the text.

    Equal hashes meet in one sort of (hash, position), so the cost is n log n for the longest text
    as well.
    """
    def count(s: F.Column) -> F.Column:
        twice = F.transform(s, lambda e, k: F.when((e["h"] == F.get(s, k - 1)["h"]) | (e["h"] == F.get(s, k + 1)["h"]), e["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        add = lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last"))
        return F.aggregate(F.sort_array(F.filter(twice, lambda i: i.isNotNull())), start, add, lambda a: a["n"])

    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(placed, count))


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, the measurements (long) and ``failed`` (bigint of failure bits) of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    body = F.btrim(text, F.lit(SPACE))
    words = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size("_words")
    measured = (
        docs.select("doc_id", text.alias("_text"), words.alias("_words"), lines.alias("_lines"))
        .select(
            "doc_id",
            n.cast("long").alias("n_words"),
            F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
            F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.size("_lines").cast("long").alias("n_lines"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            _let(F.col("_words"), lambda w: _let(_windows(w), _covered)).cast("long").alias("n_repeat_words"),
            F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
            F.regexp_count("_text", F.lit("!")).cast("long").alias("n_exclamations"),
        )
    )
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, rule) in enumerate(RULES)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured.select("*", failed.alias("failed"))


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with ``rejected_by`` (bits of this policy that failed) and ``kept``."""
    hit = F.col("failed").bitwiseAND(F.lit(policy.mask))
    return rows.select("*", hit.alias("rejected_by"), (hit == 0).alias("kept"))


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that no other rule rejects.

    The ledger is first counted by failure pattern (at most 2^rules rows), so the ablation itself
    never sees a document.
    """
    patterns = rows.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << BITS[r]).cast("long").alias("bit")) for r in policy.rules]))
    return (
        patterns.select("bits", "n", rules.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("only_this"),
        )
        .select(F.lit(policy.version).alias("policy"), "rule", "failed", "only_this")
    )
