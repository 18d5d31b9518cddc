"""SimHash fingerprints and near-duplicate groups by a segment-popcount grid.

Each half of a fingerprint, 32 bits, is laid out as a square of eight rows and eight columns of four bits,
and mapped to the vector of their sixteen bit counts. A differing bit changes one row and one column by
one, so the Manhattan distance of two vectors is at most twice the number of differing bits: a lower
bound. Fingerprints that differ in at most ``RADIUS`` bits differ in at most ``RADIUS // 2`` in one half,
so their vectors there are at most ``RADIUS`` apart, and some vector lies within one bit of both. So each
distinct fingerprint goes to its own grid cell and those one bit away in either half, the pairs of a cell
are verified exactly with numpy on blocks, and of the links found only a spanning forest leaves the task.
Connected components then run on fingerprints, never on copies.

A cell above ``BLOCK`` fingerprints is dealt out as pairs of blocks, so no task holds more than two
blocks at once and no link is lost.

Defined cases: null text has no words and fingerprint zero, linked like any other; rows with the
same text share a fingerprint; a null ``doc_id`` never names a component unless all its rows are
null; very long texts are hashed whole, in blocks of shingles; an empty table gives no rows; extra
columns are ignored (``deduplicate`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reefline.llm._bytes import LOWER
from reefline.llm._frames import map_text, meet, plain, written

SHINGLE = 4
RADIUS = 4
#: Row and column of each of the 32 bits of a half: eight of each, four bits long.
ROW = np.arange(32) // 4
COLUMN = (np.arange(32) // 4 + np.arange(32) % 4 * 2) % 8
BLOCK = 4096
PAIRS = 1 << 21
_LOWER = LOWER.tobytes()


def fingerprint(text: str | None) -> int:
    import xxhash

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(SHINGLE, len(words))
    one = xxhash.xxh64_intdigest
    hashes = np.fromiter((one(joined[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, len(words) - k + 1)
    set_in = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)]
        set_in += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and ``fp`` (the 64 bits as a long)."""

    def run(texts: pa.Array) -> dict[str, pa.Array]:
        found = np.fromiter((fingerprint(t) for t in texts.to_pylist()), np.uint64, len(texts))
        return {"fp": pa.array(found.view(np.int64))}

    return map_text(docs, run, "fp long", keep)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links u-v that isn't the least of its component, and that least node."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            break
        np.minimum.at(label, np.maximum(la, lb)[open_], np.minimum(la, lb)[open_])
        while not np.array_equal(up := label[label], label):
            label = up
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _links(fp: np.ndarray, first: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified links inside cells: rows from ``first[k]`` on are a cell; pairs of a divided cell
    meet only across its two sides (or within, where both are the same block).
    """
    size = np.diff(np.append(first, len(fp)))
    left = np.repeat(first + size, size) - np.arange(len(fp)) - 1  # partners after each row
    total = np.concatenate(([0], np.cumsum(left)))
    i = 0
    while i < len(fp):
        j = max(i + 1, int(np.searchsorted(total, total[i] + PAIRS, "right")) - 1)
        n = left[i:j]
        a = np.repeat(np.arange(i, j), n)
        b = a + 1 + np.arange(n.sum()) - np.repeat(total[i:j] - total[i], n)
        near = (side[a] != side[b]) | (side[a] == 0)
        near &= np.bitwise_count(fp[a] ^ fp[b]) <= RADIUS
        if near.any():
            yield fp[a[near]], fp[b[near]]
        i = j


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell and part: fp, cell, part, side. Cells reach over batches."""
    rest: list[np.ndarray] | None = None

    def done(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        fp, cell, part, side = cols
        if not len(fp):
            return
        new = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]))))
        got: list[tuple[np.ndarray, np.ndarray]] = []
        for u, v in _links(fp.view(np.uint64), new, side):
            got.append(forest(u, v))
        if got:
            node, root = forest(np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got]))
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(root.view(np.int64))], names=["u", "v"])

    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if rest is not None:
            cols = [np.concatenate((r, c)) for r, c in zip(rest, cols, strict=True)]
        cell, part = cols[1], cols[2]
        if not len(cell):
            continue
        last = int(np.flatnonzero((cell != cell[-1]) | (part != part[-1]))[-1]) + 1 if (cell[0] != cell[-1] or part[0] != part[-1]) else 0
        yield from done([c[:last] for c in cols])
        rest = [c[last:] for c in cols]
    if rest is not None:
        yield from done(rest)


def _cells(fp: np.ndarray) -> np.ndarray:
    """Cells of each fingerprint, 66 to a row: in either half its own, and those one bit away."""
    out = np.empty((len(fp), 66), np.int64)
    for half in range(2):
        bits = (fp[:, None] >> (np.uint64(32 * half) + np.arange(32, dtype=np.uint64)) & np.uint64(1)).astype(np.int64)
        step = (np.int64(1) << (3 * ROW)) + (np.int64(1) << (24 + 3 * COLUMN))
        own = bits @ step + (np.int64(half) << 48)
        out[:, 33 * half] = own
        out[:, 33 * half + 1 : 33 * half + 33] = own[:, None] + (1 - 2 * bits) * step
    return out


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy()
        for i in range(0, len(fp), 1 << 13):
            part = fp[i : i + (1 << 13)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, 66)), pa.array(_cells(part.view(np.uint64)).ravel())], names=["fp", "cell"])


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """``u, v``: a spanning forest, by cell, of all links among distinct fingerprints ``fp``."""
    rows = distinct.select("fp").mapInArrow(_spread, "fp long, cell long")
    many = rows.groupBy("cell").count().where(F.col("count") > block).select("cell", F.ceil(F.col("count") / block).cast("int").alias("_g"))
    many = written(many, "cells")
    if many.isEmpty():
        dealt = rows.select("fp", "cell", F.lit(0).alias("part"), F.lit(0).alias("side"))
    else:
        b = F.pmod(F.xxhash64("fp"), F.col("_g")).cast("int")
        own = F.transform(F.sequence(F.lit(0), F.col("_g") - 1), lambda j: F.struct((F.least(b, j) * F.col("_g") + F.greatest(b, j) + 1).alias("part"), F.when(b == j, 0).when(b < j, 1).otherwise(2).alias("side")))
        alone = F.array(F.struct(F.lit(0).alias("part"), F.lit(0).alias("side")))
        dealt = rows.join(many, "cell", "left").select("fp", "cell", F.explode(F.when(F.col("_g").isNull(), alone).otherwise(own)).alias("x")).select("fp", "cell", "x.part", "x.side")
    spread = dealt.repartition("cell", "part").sortWithinPartitions("cell", "part")
    return spread.mapInArrow(_verify, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of the links ``u, v`` (longs): root is the least node of a component.

    Large-star and small-star rounds; each writes its links to the shared folder, and the loop ends
    when a round changes none. Nodes without a link aren't listed.
    """
    spark = edges.sparkSession
    state = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    state = written(state, "links")
    size = state.count()
    if not size:
        return spark.createDataFrame([], "node long, root long")
    seen = None
    while True:
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("_n"))
        large = meet(both.where("v > u"), least, ["u"], 2 * size).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
        small = meet(large, least, ["u"], 2 * size).select("v", "u", "m")
        state = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        state = written(state, "links")
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen, size = now, now[0]


def groups(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Each row's ``doc_id`` (and ``keep``), ``fp``, ``component_id``, and ``first``: whether the row
    is the representative of its component (the one with the least doc_id, then ``keep``).
    """
    keep = ["doc_id", *(keep or [])]
    found = written(fingerprints(docs, keep), "fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), *keep)
    distinct = written(found.groupBy("fp").agg(F.min(rank).alias("lead"), F.count("*").alias("_n")), "distinct")
    root = components(links(distinct.select("fp")))
    placed = distinct.join(root, distinct["fp"] == root["node"], "left").select("fp", "lead", "_n", F.coalesce("root", "fp").alias("root"))
    lead = placed.groupBy("root").agg(F.min("lead").alias("lead"), F.count("*").alias("_n"))
    by_print = meet(placed.select("fp", "root", F.col("_n").alias("_rows")), lead, ["root"]).select("fp", "lead", F.col("_rows").alias("_n"))
    return meet(found, written(by_print, "leads"), ["fp"]).select(*keep, "fp", F.col("lead.doc_id").alias("component_id"), (rank == F.col("lead")).alias("first"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, that lead their near-duplicate group; one row of each."""
    named, back = plain(docs)
    hashed = named.withColumn("_h", F.xxhash64(F.coalesce("text", F.lit(""))))
    lead = groups(hashed, ["_h"]).where("first").select(F.col("doc_id").alias("_id"), F.col("_h").alias("_lead_h")).distinct()
    kept = hashed.join(lead, hashed["doc_id"].eqNullSafe(lead["_id"]) & (hashed["_h"] == lead["_lead_h"]), "left_semi")
    once = F.row_number().over(W.partitionBy("doc_id", "_h").orderBy("_h"))
    return back(kept.withColumn("_n", once).where("_n = 1"))
