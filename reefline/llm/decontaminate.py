"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``WINDOW`` consecutive words of each benchmark item; an item of fewer
words is one shorter pattern. For each pattern length a shift table over hashes of ``BLOCK``
neighbouring words tells how far the search may jump; where the shift is zero, the bucket of the
window's suffix and prefix blocks selects test strings, whose words are then compared byte by byte.
Texts advance side by side: each stretch of ``STRETCH`` words has a cursor of its own, and one
numpy step moves all cursors of a chunk.

The benchmark's texts go to the executors in groups of at most ``GROUP_BYTES`` with their ids (the
bound of each broadcast, checked before it is sent); every Python worker builds a group's tables once,
as arrays of about 30 bytes for each byte of text (100 while they are built). A larger benchmark has several groups. The
documents are read once all the same: a task gathers ``GATHER`` bytes of texts and lets one group after another pass
over them, with the tables of one group at a time. Nothing is shuffled or joined.

Defined cases: null text has no words; an item without words has no window; a null ``item_id`` is
the empty string; items with the same id are one item; a document without words is not
contaminated; repeated rows are judged alike, each on its own; very long texts are searched whole, a
chunk of their own; columns beside the named ones are ignored by ``find`` and kept by
``remove_contaminated``, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reefline.llm import _bytes
from reefline.llm._frames import map_text, plain, written

WINDOW = 13
BLOCK = 2
STRETCH = 256
GROUP_BYTES = 4 << 20
#: Bytes of text that all groups go through together, so that a group's tables are built once for them.
GATHER = 64 << 20
_MUL = np.uint64(0xD6E8FEB86659FD93)


class _Items:
    """Words of a group's texts. ``kind`` numbers the different words; ``owners`` the ids of each text."""

    def __init__(self, texts: list[str], owners: list[list[int]]):
        (w,) = _bytes.words(pa.array(texts, pa.large_string()), _bytes.ALNUM, _bytes.LOWER, 1 << 62) if texts else (_bytes.split(np.zeros(0, np.uint8), np.zeros(1, np.int64), _bytes.ALNUM),)
        self.data, self.starts, self.ends, self.of, self.hash = w.data.tobytes(), w.starts, w.ends, w.of, w.hash
        self.kind = np.unique(w.hash, return_inverse=True)[1]
        lead = np.zeros(len(self.kind), np.int64)
        lead[self.kind[::-1]] = np.arange(len(self.kind))[::-1]  # the first word of each kind
        odd = np.flatnonzero(~_alike(w.data, w.starts, w.ends, w.data, w.starts[lead[self.kind]], w.ends[lead[self.kind]]))
        self.kind[odd] = len(self.kind) + odd  # another word of the same hash stays on its own
        self.owner_ends = np.concatenate(([0], np.cumsum([len(x) for x in owners], dtype=np.int64)))
        self.owners = np.array([i for x in owners for i in x], np.int64)


def _alike(a: np.ndarray, a_lo: np.ndarray, a_hi: np.ndarray, b: np.ndarray, b_lo: np.ndarray, b_hi: np.ndarray) -> np.ndarray:
    """Whether the stretches of bytes are equal, pair by pair."""
    same = a_hi - a_lo == b_hi - b_lo
    live, j = np.flatnonzero(same), 0
    while len(live := live[a_hi[live] - a_lo[live] > j]):
        bad = a[a_lo[live] + j] != b[b_lo[live] + j]
        same[live[bad]] = False
        live, j = live[~bad], j + 1
    return same


class _Patterns:
    """All different windows of ``m`` words, in the order of their keys."""

    def __init__(self, m: int, items: _Items):
        n = np.diff(items.of)
        fits = np.flatnonzero(n >= m if m == WINDOW else n == m)
        each = n[fits] - m + 1
        text = np.repeat(fits, each)
        first = items.of[text] + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        place = first[:, None] + np.arange(m)
        order = np.lexsort(items.kind[place].T[::-1])
        kinds = items.kind[place[order]]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (kinds[1:] != kinds[:-1]).any(1)
        lead = order[fresh]
        self.text_ends = np.append(np.flatnonzero(fresh), len(order))  # of the texts that hold each window
        self.texts = text[order]
        hashes = items.hash[place[lead]]
        self.m, self.b = m, min(BLOCK, m)
        self.bits = max(12, int(np.ceil(np.log2(len(hashes) * m + 1))) + 2)
        self.default = m - self.b + 1
        self.shift = np.full(1 << self.bits, self.default, np.uint8)
        for end in range(self.b - 1, m):
            np.minimum.at(self.shift, self.slot(self.block(hashes, end)), np.uint8(m - 1 - end))
        key = self.key(self.block(hashes, self.b - 1), self.block(hashes, m - 1))
        by_key = np.argsort(key, kind="stable")
        self.keys, self.hashes, self.first, self.rank = key[by_key], hashes[by_key], first[lead][by_key], by_key

    def owners(self, pattern: int, items: _Items) -> set[int]:
        r = self.rank[pattern]
        texts = np.unique(self.texts[self.text_ends[r] : self.text_ends[r + 1]])
        return {int(i) for x in texts for i in items.owners[items.owner_ends[x] : items.owner_ends[x + 1]]}

    def block(self, h: np.ndarray, end: int) -> np.ndarray:
        return h[:, end] if self.b == 1 else h[:, end - 1] * _MUL + h[:, end]

    def block_at(self, h: np.ndarray, end: np.ndarray) -> np.ndarray:
        return h[end] if self.b == 1 else h[end - 1] * _MUL + h[end]

    def slot(self, block: np.ndarray) -> np.ndarray:
        return (_bytes.mix(block) >> np.uint64(64 - self.bits)).astype(np.int64)

    @staticmethod
    def key(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        return _bytes.mix(prefix * _MUL ^ suffix)

    def search(self, w: _bytes.Words, items: _Items) -> tuple[np.ndarray, np.ndarray]:
        """Last words of occurrences and the pattern at each."""
        m, h = self.m, w.hash
        first, last = w.of[:-1] + m - 1, w.of[1:]  # window ends of each text: first to last - 1
        n = np.maximum(0, -(-(last - first) // STRETCH))
        doc = np.repeat(np.arange(w.n), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = first[doc] + k * STRETCH
        stop = np.minimum(at + STRETCH, last[doc])
        zero = []
        while len(at):
            s = self.shift[self.slot(self.block_at(h, at))].astype(np.int64)
            hit = s == 0
            if hit.any():
                zero.append(at[hit])
                s[hit] = 1
            at = at + s
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
        if not zero:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        end = np.concatenate(zero)
        key = self.key(self.block_at(h, end - m + self.b), self.block_at(h, end))
        lo, hi = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        n = hi - lo
        end, pat = np.repeat(end, n), np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        for j in range(m):
            same = h[end - m + 1 + j] == self.hashes[pat, j]
            end, pat = end[same], pat[same]
        place = np.arange(m)
        mine, theirs = (end[:, None] - m + 1 + place).ravel(), (self.first[pat][:, None] + place).ravel()
        sure = _alike(w.data, w.starts[mine], w.ends[mine], np.frombuffer(items.data, np.uint8), items.starts[theirs], items.ends[theirs]).reshape(-1, m).all(1)
        return end[sure], pat[sure]


class Group:
    """Some items of the benchmark: their texts, the ids of each, and the tables, built where they are used."""

    _built: dict[str, tuple[_Items, list[_Patterns]]] = {}

    def __init__(self, rows: list[tuple[list[str], str]]):
        self.name = uuid.uuid4().hex
        self.ids = sorted({i for ids, _ in rows for i in ids})
        place = {x: k for k, x in enumerate(self.ids)}
        self.texts, self.owned = [x for _, x in rows], [sorted({place[i] for i in ids}) for ids, _ in rows]

    def tables(self) -> tuple[_Items, list[_Patterns]]:
        if self.name not in self._built:
            self._built.clear()
            items = _Items(self.texts, self.owned)
            self._built[self.name] = items, [_Patterns(int(m), items) for m in np.unique(np.minimum(np.diff(items.of), WINDOW)) if m]
        return self._built[self.name]


def _scan(texts: pa.Array, group: Group) -> dict[str, pa.Array]:
    n_words, spans, items = [], [], []
    held, patterns = group.tables()
    ids = group.ids
    for w in _bytes.words(texts, _bytes.ALNUM, _bytes.LOWER):
        n_words.append(np.diff(w.of))
        edge = np.zeros(len(w.starts) + 1, np.int64)
        owned: dict[int, set[int]] = {}
        for p in patterns:
            end, pat = p.search(w, held)
            np.add.at(edge, end - p.m + 1, 1)
            np.add.at(edge, end + 1, -1)
            for d, q in set(zip((np.searchsorted(w.of, end, "right") - 1).tolist(), pat.tolist(), strict=True)):
                owned.setdefault(d, set()).update(p.owners(q, held))
        hit = np.cumsum(edge[:-1]) > 0
        per, own = [[] for _ in range(w.n)], [[] for _ in range(w.n)]
        for d, got in owned.items():
            inside = np.flatnonzero(np.diff(np.concatenate(([0], hit[w.of[d] : w.of[d + 1]].view(np.int8), [0]))))
            per[d] = [{"start": int(a), "stop": int(b)} for a, b in inside.reshape(-1, 2)]
            own[d] = sorted(ids[x] for x in got)
        spans += per
        items += own
    return {
        "n_words": pa.array(np.concatenate(n_words) if n_words else [], pa.int64()),
        "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
        "item_ids": pa.array(items, pa.list_(pa.string())),
    }


def _scan_all(texts: pa.Array, sent: list) -> dict[str, pa.Array]:
    """The same for all groups, one after another; the group whose tables stand goes first. Ranges may overlap."""
    order = sorted(range(len(sent)), key=lambda g: sent[g].value.name not in Group._built)
    n_words, spans, items = None, [[] for _ in range(len(texts))], [[] for _ in range(len(texts))]
    for g in order:
        got = _scan(texts, sent[g].value)
        n_words = got["n_words"]
        for d in np.flatnonzero(got["item_ids"].value_lengths().to_numpy()).tolist():
            spans[d] += got["spans"][d].as_py()
            items[d] += got["item_ids"][d].as_py()
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    return {"n_words": n_words, "spans": pa.array(spans, kind), "item_ids": pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))}


MADE = "n_words long, spans array<struct<start:int,stop:int>>, item_ids array<string>"


def _gathered(docs: DataFrame, sent: list, keep: list[str]) -> DataFrame:
    """``_scan_all`` on ``GATHER`` bytes of texts at a time, with the columns ``keep``."""
    k = len(keep)
    source = docs.select(*[docs[c].alias(f"_k{i}") for i, c in enumerate(keep)], docs["text"].alias("_text"))
    schema = T.StructType([docs.schema[c] for c in keep] + T._parse_datatype_string(MADE).fields)
    names = [f.name for f in schema.fields]

    def made(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, at = _scan_all(pa.concat_arrays([b.column(k) for b in held]), sent), 0
        for b in held:
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(k)), *(got[c].slice(at, b.num_rows) for c in names[k:])], names=names)
            at += b.num_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.column(k).nbytes
            if size >= GATHER:
                yield from made(held)
                held, size = [], 0
        if held:
            yield from made(held)

    return source.mapInArrow(run, schema)


def find(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (``doc_id``) and n_words, spans (word ranges inside occurrences), item_ids
    (sorted as strings), n_hit, contaminated.
    """
    keep = ["doc_id"] if keep is None else keep
    spark = docs.sparkSession
    items = written(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.coalesce("text", F.lit("")).alias("text")).distinct(), "items")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("id") + 16), F.lit(0))).first()[0]
    n_groups = max(1, -(-total // GROUP_BYTES))
    sent = []
    for g in range(n_groups):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_groups)) == g).collect()  # GROUP_BYTES, about
        by_text: dict[str, list[str]] = {}
        for r in rows:
            by_text.setdefault(r.text, []).append(r.id)
        sent.append(spark.sparkContext.broadcast(Group([(ids, text) for text, ids in by_text.items()])))
    if n_groups == 1:
        found = map_text(docs, lambda t: _scan(t, sent[0].value), MADE, keep)
    else:
        found = _gathered(docs, sent, keep).withColumn("spans", _merged("spans"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _merged(spans: str) -> F.Column:
    """Overlapping ranges joined."""
    kind = "array<struct<start:int,stop:int>>"

    def step(done: F.Column, s: F.Column) -> F.Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["stop"] >= s["start"]), joined).otherwise(F.concat(done, F.array(s))).cast(kind)

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), step)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, that are not contaminated."""
    named, back = plain(docs)
    names = [c for c in named.columns if c.startswith("_c")]
    return back(find(named, benchmark, names).where(~F.col("contaminated")))


def items_digest(ids: str) -> F.Column:
    return F.sha2(F.array_join(ids, ","), 256)
