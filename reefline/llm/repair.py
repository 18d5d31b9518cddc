"""Repair of conversations: the cheapest edits that make roles alternate, by a checkpointed dynamic programme.

A conversation's roles have to read ``(s?(ua)+)?`` (system, user, assistant by their initials). Rows may
be kept (0), given the role that is due, user or assistant (2), or deleted (3: required for blank rows
and for repeats of an earlier row), and rows without text inserted anywhere (2); a truncated row that stays
costs 1 more. Of all cheapest edit lists the one whose initials (D, I, K, R) are ASCII-least is taken.

The programme runs over four states: nothing yet, after system, after user, after assistant. Backward
vectors of least costs are stored only at checkpoints about the square root of a conversation apart,
and the blocks between them are recomputed while walking forward. Blocks are the unit of work on the
cluster too, so a conversation of any length is spread over tasks: each block gives the costs from every
state at its start to every state at its end; the backward pass over a conversation's blocks gives the
vectors at the checkpoints; each block then walks forward from each state it may be entered in; a pass over
blocks tells which of these walks is real. A conversation of up to ``LEAST_BLOCK`` rows is one block.

Only the digest of the repaired text needs a conversation's texts in one place: it is taken from a stream
of sorted rows, in constant memory but for the edit initials, which are one cell of the result.

Defined cases: a null role or text is one space; a null ``conv_id`` is a conversation of its own; rows of a
conversation are ordered by turn (null first), role and the digest of their text; a row is blank without a
character beyond white space, else a repeat if an earlier row has its role and text, else truncated if its
last such character is none of ``.!?``; rows of any other role can only be deleted or given a role; extra
columns are ignored, whatever their names; an empty table gives an empty frame.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reefline.llm._frames import meet, written
from reefline.llm.manifest import placed

SPACE = " \t\n\x0b\x0c\r"
LEAST_BLOCK = 256
#: Cells of a table of codes that are worked on at once; bounds memory only.
CELLS = 1 << 21
RETAG, DELETE, INSERT, CUT = 2, 3, 2, 1
FAR = 1 << 40
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. The state after the role that is due:
DUE = np.array([2, 2, 3, 2])
#: The state after a kept row, by state and initial (other, s, u, a); -1 if it can't be kept.
KEPT = np.array([[-1, 1, 2, -1], [-1, -1, 2, -1], [-1, -1, -1, 3], [-1, -1, 2, -1]])
#: Least costs behind the last row.
END = np.array([0, 2 * INSERT, INSERT, 0])
KEY = ["_none", "_c"]


def _due(v: np.ndarray) -> np.ndarray:
    """Costs with insertions before them allowed; the state is axis 1."""
    out = v.copy()
    out[:, 2] = np.minimum(v[:, 2], INSERT + v[:, 3])
    out[:, 3] = np.minimum(v[:, 3], INSERT + v[:, 2])
    out[:, 0] = np.minimum(v[:, 0], INSERT + out[:, 2])
    out[:, 1] = np.minimum(v[:, 1], INSERT + out[:, 2])
    return out


def _before(v: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Costs before a row of each block from those after it; code: initial, plus 4 if it has to go, plus 8 if it is cut."""
    shape = (len(code),) + (1,) * (v.ndim - 2)
    kill, cut, initial = (code & 4).astype(bool).reshape(shape), (code >> 3 & 1).reshape(shape), code & 3
    out = DELETE + v
    for s in range(4):
        stay = RETAG + v[:, DUE[s]]
        after = KEPT[s][initial]
        kept = np.where((after >= 0).reshape(shape), v[np.arange(len(code)), after], FAR)
        out[:, s] = np.where(kill, out[:, s], np.minimum(out[:, s], cut + np.minimum(stay, kept)))
    return _due(out)


def backward(codes: np.ndarray, lengths: np.ndarray, v: np.ndarray, store: bool) -> np.ndarray:
    """The costs before the first row of each block, or before all of its rows and at its end."""
    held = [v] if store else []
    for t in range(codes.shape[1] - 1, -1, -1):
        on = lengths > t
        v = v.copy()
        v[on] = _before(v[on], codes[on, t])
        if store:
            held.append(v)
    return np.stack(held[::-1], 1) if store else v


def forward(codes: np.ndarray, lengths: np.ndarray, v: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """State at each block's end and its edits' initials; v: all costs, last: whether the conversation ends there."""
    state, letters = state.copy(), []

    def note(rows: np.ndarray, letter: str) -> None:
        column = np.zeros(len(state), np.uint8)
        column[rows] = ord(letter)
        letters.append(column)

    for t in range(codes.shape[1]):
        todo = np.flatnonzero(lengths > t)
        while len(todo):
            s, code = state[todo], codes[todo, t]
            now, then = v[todo, t], v[todo, t + 1]
            at = np.arange(len(todo))
            cost, cut = now[at, s], code >> 3 & 1
            gone = cost == DELETE + then[at, s]
            more = ~gone & (cost == INSERT + now[at, DUE[s]])
            after = KEPT[s, code & 3]
            stays = ~gone & ~more & (code & 4 == 0) & (after >= 0) & (cost == cut + then[at, after])
            new = ~gone & ~more & ~stays
            state[todo[more | new]] = DUE[s[more | new]]
            state[todo[stays]] = after[stays]
            column = np.zeros(len(state), np.uint8)
            for rows, letter in ((gone, "D"), (more, "I"), (stays, "K"), (new, "R")):
                column[todo[rows]] = ord(letter)
            letters.append(column)
            todo = todo[more]
    for _ in range(2):
        rows = np.flatnonzero(last & ((state == 1) | (state == 2)))
        note(rows, "I")
        state[rows] = DUE[state[rows]]
    table = np.stack(letters, 1)
    return state, [row[row > 0].tobytes() for row in table]


def _tables(codes: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, table of codes (a block to a row) and lengths of some blocks of like length at a time."""
    lengths = codes.value_lengths().to_numpy()
    flat, starts = codes.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lengths)))
    order = np.argsort(-lengths, kind="stable")
    i = 0
    while i < len(order):
        width = max(1, int(lengths[order[i]]))
        some = order[i : i + max(1, CELLS // width)]
        own = lengths[some]
        table = np.zeros((len(some), width), np.int64)
        table[np.arange(width) < own[:, None]] = np.concatenate([flat[starts[k] : starts[k] + n] for k, n in zip(some, own, strict=True)])
        yield some, table, own
        i += len(some)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs from each state at a block's start to each at its end; a row for each block."""
    for batch in batches:
        out = np.zeros((batch.num_rows, 16), np.int64)
        for some, table, lengths in _tables(batch["codes"]):
            v = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, FAR), (len(some), 4, 4))
            out[some] = np.minimum(backward(table, lengths, v, False), FAR).reshape(-1, 16)
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in (*KEY, "block")), _lists(out)], names=[*KEY, "block", "m"])


def _lists(rows: np.ndarray) -> pa.Array:
    n, k = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k), pa.int32()), pa.array(rows.reshape(-1)))


def _checkpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Backward over a conversation's blocks: the cost vector at each block's end."""
    for batch in batches:
        for k in range(batch.num_rows):
            steps = batch["steps"].slice(k, 1).flatten()
            m = steps.field("m").flatten().to_numpy().reshape(-1, 4, 4)
            v = np.zeros((len(m) + 1, 4), np.int64)
            v[-1] = END
            for i in range(len(m) - 1, -1, -1):
                v[i] = (m[i] + v[i + 1]).min(1)
            same = pa.array(np.zeros(len(m), np.int64))
            yield pa.RecordBatch.from_arrays([*(batch[c].slice(k, 1).take(same) for c in KEY), steps.field("block"), _lists(v[1:])], names=[*KEY, "block", "v"])


def _illegal(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Whether neighbouring initials (of codes) are none of su, ua, au."""
    pair = 4 * (before & 3) + (after & 3)
    return ~np.isin(pair, [4 * 1 + 2, 4 * 2 + 3, 4 * 3 + 2])


_WALK = {"state": "long", "exit": "long", "cost": "long", "illegal": "long", "head": "long", "tail": "long", "edits": "string"}


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each state a block may be entered in: the state it is left in, the least cost from there on and the edits;
    also illegal neighbours in the block, and its first and last codes.
    """
    own = [*KEY, "block", "n_blocks", "first"]
    for batch in batches:
        block, n_blocks = batch["block"].to_numpy(), batch["n_blocks"].to_numpy()
        ends = batch["v"].flatten().to_numpy().reshape(-1, 4)
        for some, table, lengths in _tables(batch["codes"]):
            v = backward(table, lengths, ends[some], True)
            inside = np.arange(1, table.shape[1]) < lengths[:, None]
            illegal = (_illegal(table[:, :-1], table[:, 1:]) & inside).sum(1)
            tail = table[np.arange(len(some)), lengths - 1]
            for s in range(4):
                on = np.flatnonzero((block[some] > 0) | (s == 0))
                if not len(on):
                    continue
                left, edits = forward(table[on], lengths[on], v[on], np.full(len(on), s), block[some[on]] == n_blocks[some[on]] - 1)
                at = pa.array(some[on])
                made = [np.full(len(on), s), left, v[on, 0, s], illegal[on], table[on, 0], tail[on]]
                yield pa.RecordBatch.from_arrays([*(batch[c].take(at) for c in own), *map(pa.array, made), pa.array([e.decode() for e in edits], pa.string())], names=[*own, *_WALK])


def _entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forward over a conversation's blocks: the state each is entered in, and whether the roles at its start are illegal."""
    for batch in batches:
        for k in range(batch.num_rows):
            steps = batch["steps"].slice(k, 1).flatten()
            to = steps.field("to").flatten().to_numpy().reshape(-1, 4)
            state = np.zeros(len(to), np.int64)
            for i in range(1, len(to)):
                state[i] = to[i - 1, state[i - 1]]
            joint = np.zeros(len(to), np.int64)
            joint[1:] = _illegal(steps.field("tail").to_numpy()[:-1], steps.field("head").to_numpy()[1:])
            same = pa.array(np.zeros(len(to), np.int64))
            yield pa.RecordBatch.from_arrays([*(batch[c].slice(k, 1).take(same) for c in KEY), steps.field("block"), pa.array(state), pa.array(joint)], names=[*KEY, "block", "state", "joint"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted edits of blocks and rows: a conversation's initials and the digest of its repaired rows.

    A block's edits stand right before its rows. Rows stream through; nothing of them is kept.
    """
    key, state, letters, parts, sha, some = None, 0, iter(()), [], None, False
    role = ("user", "assistant")

    def say(text: str) -> None:
        nonlocal some
        sha.update(("\n" if some else "").encode() + text.encode())
        some = True

    def due() -> str:
        nonlocal state
        state = int(DUE[state])
        return role[state - 2]

    def rest() -> None:
        for _ in letters:  # only insertions stand behind the last row
            say(f"{due()}:")

    done: list[tuple] = []

    def out() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        done.clear()
        kinds = (pa.bool_(), key_type, pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*KEY, "audit", "repaired_sha256"])

    key_type = None
    for batch in batches:
        key_type = batch.schema.field("_c").type
        for none, c, edits, who, text in zip(*(batch[n].to_pylist() for n in (*KEY, "edits", "role", "text")), strict=True):
            if (none, c) != key:
                if key is not None:
                    rest()
                    done.append((*key, "".join(parts), sha.hexdigest()))
                key, state, letters, parts, sha, some = (none, c), 0, iter(()), [], hashlib.sha256(), False
            if edits is not None:
                rest()
                parts.append(edits)
                letters = iter(edits)
                continue
            for letter in letters:
                if letter == "I":
                    say(f"{due()}:")
                    continue
                if letter == "K":
                    state = {"s": 1, "u": 2, "a": 3}[who[0]]
                    say(f"{who}:{text}")
                elif letter == "R":
                    say(f"{due()}:{text}")
                break
        if len(done) >= 1000:
            yield out()
    if key is not None:
        rest()
        done.append((*key, "".join(parts), sha.hexdigest()))
    if done:
        yield out()


def _key(conv_id: Column, kind: str) -> list[Column]:
    return [conv_id.isNull().alias("_none"), F.coalesce(conv_id, F.lit("0" if kind != "string" else "").cast(kind)).alias("_c")]


def repair(rows: DataFrame) -> DataFrame:
    """A row for each conversation: ``conv_id``, ``gaps``, faults (``blank``, ``duplicate``, ``truncated``), ``illegal`` (neighbouring
    roles in no allowed order), ``cost``, ``audit`` (the edits' initials) and ``repaired_sha256``.
    """
    kind = dict(rows.dtypes)["conv_id"]
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    body = F.rtrim(text, F.lit(SPACE))
    initial = F.coalesce(F.array_position(F.array(F.lit("s"), F.lit("u"), F.lit("a")), F.substring(role, 1, 1)), F.lit(0)).cast("int")
    told = rows.select(
        *_key(F.col("conv_id"), kind), "turn", role.alias("role"), text.alias("text"), F.sha2(text.cast("binary"), 256).alias("sha"), initial.alias("initial"),
        (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    order = [F.col("_none").desc(), F.col("_c"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("sha")]
    held = placed(told, order, {"one": F.lit(1).cast("long")}).withColumnRenamed("one", "g")

    firsts = held.groupBy(*KEY, "role", "sha").agg(F.min("g").alias("g")).select("g", F.lit(True).alias("fresh"))
    small = held.select("g", *KEY, "turn", "initial", "blank", "cut").join(firsts, "g", "left")
    again = ~F.col("blank") & F.col("fresh").isNull()
    small = written(small.select("g", *KEY, "turn", "initial", "blank", again.alias("again"), (~F.col("blank") & ~again & F.col("cut")).alias("cut")), "faults")
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    convs = small.groupBy(*KEY).agg(F.count("*").alias("_n"), F.min("g").alias("_from"), F.coalesce(span, F.lit(0)).cast("long").alias("gaps"), *[F.count_if(c).alias(n) for c, n in (("blank", "blank"), ("again", "duplicate"), ("cut", "truncated"))])
    root = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("_n").cast("double")) / 2)).cast("long")
    convs = written(convs.withColumn("size", F.greatest(F.lit(LEAST_BLOCK).cast("long"), root)), "conversations")

    code = F.col("initial") + F.when(F.col("blank") | F.col("again"), 4).otherwise(0) + F.when(F.col("cut"), 8).otherwise(0)
    joined = meet(small.select("g", *KEY, code.alias("code")), convs.selectExpr(*KEY, "_n", "_n AS n", "_from", "size"), KEY, convs.count())
    at = F.col("g") - F.col("_from")
    blocks = joined.select("g", *KEY, "code", F.floor(at / F.col("size")).cast("long").alias("block"), F.ceil(F.col("n") / F.col("size")).cast("long").alias("n_blocks"))
    blocks = blocks.groupBy(*KEY, "block", "n_blocks").agg(F.sort_array(F.collect_list(F.struct("g", "code"))).alias("rows"))  # a block's rows
    blocks = written(blocks.select(*KEY, "block", "n_blocks", F.element_at("rows", 1)["g"].alias("first"), F.transform("rows", lambda r: r["code"]).alias("codes")), "blocks")

    c = f"{KEY[0]} boolean, {KEY[1]} {kind}"
    long = blocks.where("n_blocks > 1")
    across = long.select(*KEY, "block", "codes").mapInArrow(_across, f"{c}, block long, m array<long>")
    ends = across.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("block", "m"))).alias("steps")).mapInArrow(_checkpoints, f"{c}, block long, v array<long>")
    with_ends = long.join(ends, [*KEY, "block"]).unionByName(blocks.where("n_blocks = 1").withColumn("v", F.array(*[F.lit(int(x)).cast("long") for x in END])))
    made = ", ".join(f"{n} {k}" for n, k in _WALK.items())
    walks = written(with_ends.mapInArrow(_walks, f"{c}, block long, n_blocks long, first long, {made}"), "walks")
    several = walks.where("n_blocks > 1")
    left = F.map_from_entries(F.collect_list(F.struct("state", "exit")))  # four at most
    exits = several.groupBy(*KEY, "block").agg(left.alias("left"), F.max("head").alias("head"), F.max("tail").alias("tail"))
    to = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: F.coalesce(F.try_element_at("left", s.cast("long")), F.lit(0).cast("long")))
    chain = exits.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("block", to.alias("to"), "head", "tail"))).alias("steps"))
    entered = chain.mapInArrow(_entered, f"{c}, block long, state long, joint long")
    real = walks.where("n_blocks = 1").withColumn("joint", F.lit(0).cast("long")).unionByName(several.join(entered, [*KEY, "block", "state"]))

    edits = real.select(*KEY, F.col("first").alias("g"), F.lit(0).alias("_k"), "edits", F.lit("").alias("role"), F.lit("").alias("text"))
    lines = held.select(*KEY, "g", F.lit(1).alias("_k"), F.lit(None).cast("string").alias("edits"), "role", "text")
    stream = edits.unionByName(lines).repartition(*KEY).sortWithinPartitions(*KEY, "g", "_k").select(*KEY, "edits", "role", "text")
    said = stream.mapInArrow(_digests, f"{c}, audit string, repaired_sha256 string")
    sums = real.groupBy(*KEY).agg(F.sum(F.col("illegal") + F.col("joint")).alias("illegal"), F.max(F.when(F.col("block") == 0, F.col("cost"))).alias("cost"))
    whole = convs.join(said, KEY).join(sums, KEY)
    return whole.select(F.when(~F.col("_none"), F.col("_c")).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
