"""Merkle manifest of a dataset: a tree of every language's rows, and one over the languages.

The tree is built by butterfly exchange. A language's leaves are numbered in order and cut into
partitions of ``fanout ** block_levels`` consecutive leaves, so that a partition's own levels need no
other. Round by round the partitions of an aligned group of ``fanout`` subtrees then swap subtree
roots, and each of them hashes the group's parent for itself: after as many rounds as the tree has upper
levels every partition holds the root and all upper siblings, and nothing has to be handed down. Where
the last subtree of a group has fewer partitions than the others, its j-th partition answers those whose
place in their subtree leaves j when divided by their number, so that each partition hears every
sibling once and none sends to more than its share. Languages take the last rounds in the same way.

Leaves get their place without one big sort: they are dealt by range, counted by part, and the parts'
counts (a row for each part) are summed on the driver.

Defined cases: a null field is ``-`` in its leaf; a null ``lang`` is a language of its own, before all
others; rows of one language ascend by ``doc_id`` (null first), then by their leaf, so that repeated rows
are leaves beside each other; one leaf alone is its tree's root; an empty table gives an empty manifest;
very long texts are hashed as a stream of bytes by the JVM; extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reefline.llm._frames import meet, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT, BLOCK_LEVELS = 2, 9
#: Rounds after which the state is written, so that a lost executor costs few of them.
ROUNDS_KEPT = 6
_STEPS = "array<struct<l: string, r: string>>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def field(value: Column) -> Column:
    """A field of a leaf: ``-`` for null, else its length in bytes, a colon and its text."""
    s = value.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(row: dict[str, Column]) -> Column:
    return digest(F.concat(*[field(row[c]) for c in FIELDS]))


def placed(rows: DataFrame, order: list[Column], weights: dict[str, Column]) -> DataFrame:
    """The rows with, for each weight, its running total before the row in this order.

    Rows are dealt by range and sorted in parts; what reaches the driver is one row of sums for each part.
    """
    tie = F.monotonically_increasing_id().alias("_tie")  # equal rows can be dealt to several parts
    parts = rows.select("*", tie, *[w.alias(f"_w_{n}") for n, w in weights.items()])
    held = written(parts.repartitionByRange(*order, F.col("_tie")).sortWithinPartitions(*order, "_tie").withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33)
    sums = held.groupBy(part.alias("part")).agg(*[F.sum(f"_w_{n}").alias(n) for n in weights]).orderBy("part").collect()  # a row for each part
    before, so_far = [], [0] * len(weights)
    for r in sums:
        before.append((r["part"], *so_far))
        so_far = [a + r[n] for a, n in zip(so_far, weights, strict=True)]
    kind = T.StructType([T.StructField("_part", T.LongType()), *[T.StructField(f"_b_{n}", T.LongType()) for n in weights]])
    offsets = rows.sparkSession.createDataFrame(before, kind)
    if list(weights) == ["one"]:  # the place inside of a part is known
        inside = {"one": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}
        own = held.select(*rows.columns, part.alias("_part"), "_at")
    else:
        from pyspark.sql import Window as W

        up = W.partitionBy(part).orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
        inside = {n: F.col(f"_i_{n}") for n in weights}
        own = held.select(*rows.columns, part.alias("_part"), *[F.coalesce(F.sum(f"_w_{n}").over(up), F.lit(0)).alias(f"_i_{n}") for n in weights])
    return own.join(F.broadcast(offsets), "_part").select(*rows.columns, *[(F.col(f"_b_{n}") + inside[n]).alias(n) for n in weights])


def _runs(nodes: Column, fanout: int) -> Column:
    """The level above: each run of ``fanout`` nodes as one."""
    last = F.ceil(F.size(nodes) / F.lit(fanout)).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: digest(F.array_join(F.slice(nodes, i * fanout + 1, fanout), "")))


def _levels(leaves: Column, height: Column, most: int, fanout: int) -> Column:
    """All levels of a partition, from its leaves up to its one root."""
    grow = lambda a, k: F.when(k < height, F.concat(a, F.array(_let(F.element_at(a, -1), lambda top: _runs(top, fanout))))).otherwise(a)
    return F.aggregate(F.sequence(F.lit(0), F.lit(most - 1)), F.array(leaves), grow) if most else F.array(leaves)


def _sides(nodes: Column, at: Column, fanout: int) -> Column:
    """The siblings left and right of a node in its run, joined."""
    first = (F.floor(at / F.lit(fanout)) * fanout).cast("int")
    return F.struct(
        F.array_join(F.slice(nodes, first + 1, at - first), "").alias("l"),
        F.array_join(F.slice(nodes, at + 2, F.lit(fanout - 1) - (at - first)), "").alias("r"),
    )


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings, level by level, lead to."""
    return F.aggregate(steps, start, lambda a, s: digest(F.concat(s["l"], a, s["r"])))


def _exchange(state: DataFrame) -> DataFrame:
    """One round: each partition sends its subtree's root to partitions of the sibling subtrees and hashes the parent.

    ``nodes`` lists the subtrees of the partition's group (child, start, size); null or one alone of a single
    tree means that the partition is done.
    """
    own = F.struct(*[F.col(c) for c in state.columns if c != "gid"])
    mine = F.filter("nodes", lambda x: x["child"] == F.col("child"))
    sends = lambda x, me: F.when(
        F.col("gid") - me["start"] < x["size"],
        F.transform(F.sequence(F.col("gid") - me["start"], x["size"] - 1, me["size"]), lambda i: F.struct((x["start"] + i).alias("to"), F.struct(F.col("child").alias("c"), F.col("h").alias("h")).alias("said"))),
    )
    messages = F.flatten(F.filter(F.transform(F.filter("nodes", lambda x: x["child"] != F.col("child")), lambda x: sends(x, F.get(mine, F.lit(0)))), lambda m: m.isNotNull()))
    keep = F.struct(F.col("gid").alias("to"), F.lit(None).cast("struct<c: bigint, h: string>").alias("said"))
    all_sent = F.concat(F.array(keep), F.coalesce(messages, F.array().cast("array<struct<to: bigint, said: struct<c: bigint, h: string>>>")))
    sent = state.select(own.alias("own"), F.explode(all_sent).alias("m")).select(F.col("m.to").alias("gid"), "m.said", F.when(F.col("m.said").isNull(), F.col("own")).alias("own"))
    heard = sent.groupBy("gid").agg(F.first("own", ignorenulls=True).alias("own"), F.sort_array(F.collect_list("said")).alias("said"))  # fanout - 1 messages at most
    flat = heard.select("gid", "own.*", "said")
    side = lambda left: F.array_join(F.transform(F.filter("said", lambda s: (s["c"] < F.col("child")) if left else (s["c"] > F.col("child"))), lambda s: s["h"]), "")
    step = F.struct(side(True).alias("l"), side(False).alias("r"))
    done = F.col("nodes").isNull()
    met = flat.select("*", F.when(~done, step).alias("_step"))
    return met.select(
        *[c for c in state.columns if c not in ("h", "steps", "nodes", "child")],
        F.when(done, F.col("h")).otherwise(digest(F.concat("_step.l", "h", "_step.r"))).alias("h"),
        F.when(done, F.col("steps")).otherwise(F.concat("steps", F.array("_step"))).alias("steps"),
    )


def _rounds(most: int, fanout: int) -> int:
    n = 0
    while fanout**n < most:
        n += 1
    return n


def build(docs: DataFrame, tampered: Callable[[Column], Column] | None = None, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """A row for each document: ``doc_id``, ``leaf``, ``subroot``, ``root``, ``steps`` (siblings left and right on each level
    up to the root), and ``other``, the leaf of the row with one more character where ``tampered`` of the doc_id holds.
    """
    block = fanout**block_levels
    row = {c: F.col(c) for c in FIELDS}
    hit = F.coalesce(tampered(F.col("doc_id")), F.lit(False)) if tampered else F.lit(False)
    other = F.when(hit, leaf(row | {"n_chars": F.col("n_chars") + 1}))
    leaves = written(docs.select("doc_id", F.col("lang").alias("_lang"), leaf(row).alias("leaf"), other.alias("other")), "leaves")
    ordered = placed(leaves, [F.col("_lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")], {"one": F.lit(1).cast("long")})
    ordered = ordered.select("*", F.col("_lang").isNull().alias("_none"), F.coalesce("_lang", F.lit("")).alias("_l"), F.col("one").alias("g"))

    langs = ordered.groupBy("_none", "_l").agg(F.count("*").alias("_n"), F.min("g").alias("_from"))
    langs = langs.withColumn("n_blocks", F.ceil(F.col("_n") / F.lit(block)).cast("long"))
    langs = written(placed(langs, [F.col("_none").desc(), F.col("_l")], {"rank": F.lit(1).cast("long"), "base": F.col("n_blocks")}), "langs")
    n_langs, most_blocks = langs.agg(F.count("*"), F.coalesce(F.max("n_blocks"), F.lit(0))).first()

    at = F.col("g") - F.col("_from")
    joined = meet(ordered.drop("one", "_lang"), langs, ["_none", "_l"], n_langs)
    joined = joined.select("doc_id", "leaf", "other", "rank", "n_blocks", "base", F.floor(at / F.lit(block)).cast("long").alias("block"), at.alias("at"))
    grouped = joined.groupBy((F.col("base") + F.col("block")).alias("gid"), "rank", "n_blocks", "base", "block").agg(
        F.sort_array(F.collect_list(F.struct("at", "doc_id", "leaf", "other"))).alias("rows")  # one partition's leaves
    )
    tops = F.transform("rows", lambda x: x["leaf"])
    lone = sum((F.when(F.size("rows") > fanout**k, 1).otherwise(0) for k in range(block_levels)), F.lit(0))
    height = F.when(F.col("n_blocks") > 1, F.lit(block_levels)).otherwise(lone)
    blocks = written(grouped.select("gid", "rank", "n_blocks", "base", "rows", _levels(tops, height, block_levels, fanout).alias("levels")), "blocks")

    state = blocks.select("gid", "rank", "n_blocks", "base", F.element_at(F.element_at("levels", -1), 1).alias("h"), F.array().cast(_STEPS).alias("steps"))
    for r in range(_rounds(most_blocks, fanout)):
        span = fanout**r
        own = F.col("gid") - F.col("base")
        first = F.floor(own / F.lit(span * fanout)).cast("long") * (span * fanout)
        child = lambda c: F.struct(c.cast("long").alias("child"), (F.col("base") + first + c * span).alias("start"), F.least(F.lit(span).cast("long"), F.col("n_blocks") - first - c * span).alias("size"))  # noqa: E731,B023
        nodes = F.filter(F.transform(F.sequence(F.lit(0), F.lit(fanout - 1)), child), lambda x: x["size"] > 0)
        state = _exchange(state.select("*", F.floor((own - first) / F.lit(span)).cast("long").alias("child"), F.when(F.col("n_blocks") > span, nodes).alias("nodes")))
        if r % ROUNDS_KEPT == ROUNDS_KEPT - 1:
            state = written(state, "round")
    state = state.withColumn("subroot", F.col("h"))
    for r in range(_rounds(n_langs, fanout)):
        span = fanout**r
        nodes = langs.groupBy(F.floor(F.col("rank") / F.lit(span)).cast("long").alias("node")).agg(F.min("base").alias("start"), F.sum("n_blocks").alias("size"))
        group = F.floor(F.col("node") / F.lit(fanout)).cast("long").alias("_group")
        nodes = nodes.groupBy(group).agg(F.sort_array(F.collect_list(F.struct((F.col("node") % fanout).alias("child"), "start", "size"))).alias("nodes"), F.sum("size").alias("_n"))
        here = state.select("*", F.floor(F.col("rank") / F.lit(span * fanout)).cast("long").alias("_group"), F.floor(F.col("rank") / F.lit(span)).cast("long").alias("_node"))
        here = meet(here, nodes, ["_group"], math.ceil(n_langs / (span * fanout)))
        state = written(_exchange(here.select(*state.columns, (F.col("_node") % fanout).alias("child"), "nodes")), "round")

    upper = state.select("gid", "subroot", F.col("h").alias("root"), F.col("steps").alias("_upper"))
    below = lambda i: F.transform(F.slice("levels", 1, F.size("levels") - 1), lambda nodes, k: _sides(nodes, F.floor(i / F.pow(F.lit(fanout), k)).cast("int"), fanout))
    made = F.transform("rows", lambda x, i: F.struct(x["doc_id"].alias("doc_id"), x["leaf"].alias("leaf"), x["other"].alias("other"), F.concat(below(i), F.col("_upper")).alias("steps")))
    return blocks.join(upper, "gid").select("subroot", "root", F.explode(made).alias("x")).select("x.doc_id", "x.leaf", "subroot", "root", "x.steps", "x.other")


def audit(manifest: DataFrame) -> DataFrame:
    """Proofs as digests, and the root that each row's (tampered, if it is) leaf leads to."""
    sides = F.array_join(F.transform("steps", lambda s: F.concat(s["l"], s["r"])), "")
    folded = fold(F.coalesce("other", "leaf"), F.col("steps"))
    out = manifest.select("doc_id", "leaf", "subroot", "root", digest(sides).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
