"""Packing documents into sequences by a grouping genetic algorithm, on islands.

Pieces of the same length are exchangeable, so the search works on the histogram of lengths (at most
``CAPACITY`` rows, whatever the corpus), and a chromosome is a list of bin groups: a filling of a
bin and how many bins are filled so. Every island starts from cheap packings of its own: lengths in
random order, each put in by next fit or first fit. Crossover injects whole well-filled groups of
another parent, takes out bins of the receiver whose pieces would then be used twice, and puts the
displaced pieces back by best fit; mutation empties badly filled groups and packs them anew. Each
island is a Spark group with a population of its own; between epochs the best of each island moves to
the next one. Generations go on until a packing has as few bins as the total length allows, or
``GENERATIONS`` in each of ``EPOCHS`` are over. A best-fit packing is the yardstick beside it: only if the islands
need more bins than it does then does it join their population, for one more epoch; so the result is never behind it.
A best fit adds at most three groups for each length, and a child that grows beyond ``GROUPS`` groups
is dropped, so a population and the final plan are bounded for any input.

Last, every piece gets its rank among the pieces of its length (counted by salted buckets, so that a
frequent length is spread), and the plan turns rank into sequence and offset.

Defined cases: null text is empty; an empty document is one piece of the closing id alone; only
documents above the capacity are cut; repeated rows are packed each; an empty table has no pieces; a
text of any length is cut whole, texts being tokenized in blocks; of the input only doc_id and text are
read, whatever the names of other columns; pieces of equal length are ranked by doc_id, piece and ids, and
rows equal in all of these are interchangeable.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reefline.llm import tokens
from reefline.llm._frames import written

CAPACITY = 2048
CLOSING = 0
ISLANDS, POPULATION, GENERATIONS, EPOCHS = 6, 6, 6, 4
GROUPS = 4 * 3 * CAPACITY
#: Pieces in a bucket of one length, about.
BUCKET = 50_000

Group = tuple[tuple[tuple[int, int], ...], int]  # ((length, how many in a bin), ...), bins


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of each piece, and its ``ids`` if asked for."""
    schema = f"{docs.select('doc_id').schema[0].simpleString().replace(':', ' ', 1)}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, piece, start, length, crc, own = [], [], [], [], [], []
            for first, ids, bounds in tokens.texts(batch.column(1), path):
                for d in range(len(bounds) - 1):
                    whole = np.append(ids[bounds[d] : bounds[d + 1]], CLOSING).astype("<u4")
                    for k, s in enumerate(range(0, len(whole), capacity)):
                        part = whole[s : s + capacity]
                        row.append(first + d)
                        piece.append(k)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            own.append(part.astype(np.int32))
            out = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                out.append(pa.array(own, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(out)])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def best_fit(counts: dict[int, int], groups: list[Group], capacity: int = CAPACITY) -> list[Group]:
    """``groups`` and, put in from the longest on, ``counts`` pieces of each length."""
    by_room: list[list[list]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit r: a group has room r
    for filling, bins in groups:
        room = capacity - sum(x * n for x, n in filling)
        by_room[room].append([filling, bins])
        open_ |= 1 << room
    for x in sorted(counts, reverse=True):
        left = counts[x]
        while left > 0:
            fits = open_ >> x
            if not fits:
                each = capacity // x
                for n, bins in ((each, left // each), (left % each, 1)):
                    if n and bins:
                        by_room[capacity - n * x].append([((x, n),), bins])
                        open_ |= 1 << (capacity - n * x)
                break
            room = (fits & -fits).bit_length() - 1 + x
            filling, bins = by_room[room][-1]
            n = min(room // x, -(-left // bins)) if left >= bins else 1  # whole layers at once
            take = min(bins, left // n)
            if take == bins:
                by_room[room].pop()
                if not by_room[room]:
                    open_ &= ~(1 << room)
            else:
                by_room[room][-1][1] -= take
            new = room - n * x
            by_room[new].append([(*filling, (x, n)), take])
            open_ |= 1 << new
            left -= n * take
    merged: dict[tuple, int] = {}
    for some in by_room:
        for filling, bins in some:
            total: dict[int, int] = {}
            for x, n in filling:
                total[x] = total.get(x, 0) + n
            key = tuple(sorted(total.items(), reverse=True))
            merged[key] = merged.get(key, 0) + bins
    return list(merged.items())


def cheap_fit(counts: dict[int, int], rng: random.Random, capacity: int = CAPACITY) -> list[Group]:
    """All pieces, lengths in random order: next fit into the groups opened last, or first fit into the
    oldest ones. Pieces of one length stay together, so that few groups arise.
    """
    order = list(counts)
    rng.shuffle(order)
    last = rng.random() < 0.5
    open_: list[list] = []  # filling, room, bins
    for x in order:
        left = counts[x]
        for g in range(len(open_) - 1, -1, -1) if last else range(len(open_)):
            filling, room, bins = open_[g]
            if not left or last and g < len(open_) - 3:
                break
            n = room // x
            if not n:
                continue
            take = min(bins, left // n)
            if take:
                open_[g] = [filling, room, bins - take]
                open_.append([(*filling, (x, n)), room - n * x, take])
                left -= n * take
        open_ = [g for g in open_ if g[2]]
        each = capacity // x
        for n, bins in ((each, left // each), (left % each, 1)):
            if n and bins:
                open_.append([((x, n),), capacity - n * x, bins])
    return [(filling, bins) for filling, _, bins in open_]


def _fill(filling: tuple) -> int:
    return sum(x * n for x, n in filling)


def fitness(groups: list[Group], capacity: int = CAPACITY) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    bins = sum(n for _, n in groups)
    return -bins, sum(n * (_fill(f) / capacity) ** 2 for f, n in groups) / max(1, bins)


def _without(counts: dict[int, int], groups: list[Group], rng: random.Random) -> tuple[list[Group], dict[int, int]]:
    """As many bins of ``groups`` as the pieces in ``counts`` allow, and the pieces left over."""
    left, kept = dict(counts), []
    for filling, bins in rng.sample(groups, len(groups)):
        n = min(bins, *(left.get(x, 0) // k for x, k in filling))
        if n:
            kept.append((filling, n))
            for x, k in filling:
                left[x] -= n * k
    return kept, {x: n for x, n in left.items() if n}


def crossover(a: list[Group], b: list[Group], counts: dict[int, int], rng: random.Random, capacity: int = CAPACITY) -> list[Group]:
    full = [(f, n) for f, n in b if _fill(f) >= 0.98 * capacity]
    injected = [(f, n if rng.random() < 0.7 else rng.randint(1, n)) for f, n in full if rng.random() < 0.5]
    left = dict(counts)
    for f, n in injected:
        for x, k in f:
            left[x] -= n * k
    kept, displaced = _without(left, a, rng)
    return best_fit(displaced, injected + kept, capacity)


def mutate(a: list[Group], rng: random.Random, capacity: int = CAPACITY) -> list[Group]:
    """Groups with room, and a few full ones, are emptied and packed again."""
    kept, loose = [], {}
    for f, n in a:
        if rng.random() < (0.5 if _fill(f) < capacity else 0.03):
            for x, k in f:
                loose[x] = loose.get(x, 0) + n * k
        else:
            kept.append((f, n))
    return best_fit(loose, kept, capacity)


def evolve(counts: dict[int, int], members: list[list[Group]], seed: int, capacity: int = CAPACITY) -> list[list[Group]]:
    """The population after the generations of an epoch, best first."""
    rng = random.Random(seed)
    members = [*members]
    while len(members) < POPULATION:
        members.append(cheap_fit(counts, rng, capacity))
    members.sort(key=lambda m: fitness(m, capacity), reverse=True)
    bound = -(-sum(x * n for x, n in counts.items()) // capacity)
    for _ in range(GENERATIONS):
        born = [mutate(rng.choice(members), rng, capacity)]
        for _ in range(POPULATION - 1):
            a, b = rng.sample(members, 2)
            born.append(crossover(a, b, counts, rng, capacity))
        members = sorted([*members, *(m for m in born if len(m) <= GROUPS)], key=lambda m: fitness(m, capacity), reverse=True)[:POPULATION]
        if -fitness(members[0], capacity)[0] == bound:
            break  # no packing has fewer bins
    return members


_STATE = "island int, place int, fillings array<array<int>>, bins array<long>"


def plan(lengths: DataFrame, capacity: int = CAPACITY) -> list[Group]:
    """The best packing found for a frame ``length, n`` (one row for each length)."""
    import pandas as pd

    spark = lengths.sparkSession
    counts = {int(r["length"]): int(r["n"]) for r in lengths.collect()}  # at most ``capacity`` rows
    if not counts:
        return []
    packed = lambda g: ([[v for x in f for v in x] for f, _ in g], [n for _, n in g])
    state = spark.range(ISLANDS).selectExpr("cast(id AS int) AS island", "0 AS place", "CAST(array() AS array<array<int>>) AS fillings", "CAST(array() AS array<bigint>) AS bins")

    def grow(epoch: int):
        def island(pdf: pd.DataFrame) -> pd.DataFrame:
            members = [[(tuple(zip(f[0::2].tolist(), f[1::2].tolist(), strict=True)), int(n)) for f, n in zip(map(np.asarray, fs), ns, strict=True)] for fs, ns in zip(pdf["fillings"], pdf["bins"], strict=True) if len(ns)]
            k = int(pdf["island"].iloc[0])
            if epoch == EPOCHS:
                members.append(best_fit(counts, [], capacity))
            members.sort(key=lambda m: fitness(m, capacity), reverse=True)
            best = evolve(counts, members[:POPULATION], 1000 * epoch + k, capacity)
            return pd.DataFrame([(k, i, *packed(m)) for i, m in enumerate(best)], columns=["island", "place", "fillings", "bins"])

        return island

    bound = -(-sum(x * n for x, n in counts.items()) // capacity)
    yardstick = sum(n for _, n in best_fit(counts, [], capacity))
    for epoch in range(EPOCHS + 1):
        state = written(state.repartition(ISLANDS, "island").groupBy("island").applyInPandas(grow(epoch), _STATE), "islands")
        score = state.where("place = 0").withColumn("n", F.aggregate("bins", F.lit(0).cast("long"), lambda a, x: a + x))
        best = score.orderBy("n", "island").first()
        if best["n"] == bound:
            break  # no packing has fewer bins
        if epoch == EPOCHS - 1 and best["n"] <= yardstick:
            break
        # The best of each island moves on to the next as well.
        state = state.union(state.where("place = 0").withColumn("island", F.expr(f"CAST((island + 1) % {ISLANDS} AS int)")))
    return [(tuple(zip(f[0::2], f[1::2], strict=True)), n) for f, n in zip(best["fillings"], best["bins"], strict=True)]


def _slots(groups: list[Group]) -> dict[str, np.ndarray]:
    """For each length, ranks from ``first`` on go to bins from ``bin`` on, ``each`` to a bin, at ``offset``."""
    rows, used, bin_ = [], {}, 0
    for filling, bins in groups:
        offset = 0
        for x, n in filling:
            rows.append((x, used.get(x, 0), bin_, n, offset))
            used[x] = used.get(x, 0) + n * bins
            offset += x * n
        bin_ += bins
    rows.sort()
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("length", "first", "bin", "each", "offset"))}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``cut`` (``doc_id, piece, start, length, ids_crc32`` and more), each with its
    ``sequence_id`` and ``offset``. ``cut`` must be written or cheap: it is read twice.
    """
    names = cut.columns
    lengths = written(cut.groupBy("length").agg(F.count("*").alias("n")), "lengths")
    slots = _slots(plan(lengths, capacity))
    n_buckets = int(max(16, -(-(lengths.agg(F.max("n")).first()[0] or 0) // BUCKET)))
    order = [F.col(c) for c in ("doc_id", "piece", "start", "ids_crc32")]
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_buckets)).cast("int")
    held = cut.withColumn("_bucket", bucket)
    own = held.withColumn("_rank", F.row_number().over(W.partitionBy("length", "_bucket").orderBy(*order)))
    counted = held.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = counted.select("length", "_bucket", (F.sum("_n").over(W.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    ranked = own.join(before, ["length", "_bucket"]).select(*names, (F.col("_before") + F.col("_rank") - 1).alias("_rank"))
    k = names.index("length")
    sent = cut.sparkSession.sparkContext.broadcast(slots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value
        wide = 1 << 44
        keys = s["length"] * wide + s["first"]
        for batch in batches:
            if not batch.num_rows:
                continue
            x, rank = batch.column(k).to_numpy(), batch.column(len(names)).to_numpy()
            at = np.searchsorted(keys, x * wide + rank, "right") - 1
            rank = rank - s["first"][at]
            seq, off = s["bin"][at] + rank // s["each"][at], s["offset"][at] + rank % s["each"][at] * x
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    return pack(written(pieces(docs, path, capacity, with_ids), "pieces"), capacity)
