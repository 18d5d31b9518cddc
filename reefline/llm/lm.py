"""Masked pseudo-likelihood scores from a bidirectional window network trained in numpy.

The network predicts every token from ``SIDE`` tokens on either side: the embedding of each neighbour goes
through a matrix of its place, the sum through tanh, and a two-level softmax gives first the class and
then the word within it. A document's score is the sum of the log probabilities of all its tokens.

Counts cover the whole corpus: one aggregation counts every word, the most frequent ones form the
vocabulary, and all others are hashed to ``SLOTS`` slots, counted exactly, which share ``RARE`` entries of
the network. A slot has its own share of its entry's probability: count(slot) / (count(entry) + 1), and
1 / (count(entry) + 1) for all slots without a count together, so that the shares of an entry sum to 1.

Training starts from the counts: the biases of both levels give the entries' frequencies. It reads every
position of every document: the texts are dealt as ids to trainers of about ``SHARE`` tokens, and each
piece belongs to one of ``ROUNDS`` rounds. In a round each trainer trains a copy of the network once on the
windows around its own tokens, ``BLOCK`` tokens in memory at a time, in batches of short stretches taken at
random; then the copies and their learning rates are averaged part by part. A copy has a fixed size, whatever the corpus.

Defined cases: null or empty text has no tokens, log likelihood 0 and a null mean; texts of any length
are counted, learned from and scored whole; an empty table gives no rows; repeated rows count and are
scored each; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reefline.llm import _bytes
from reefline.llm._frames import map_text, written

CLASSES, WIDTH = 64, 64  # classes of the output, and words in each
VOCABULARY, RARE, SIDE, HIDDEN = CLASSES * WIDTH, 63, 2, 16
SLOTS = 1 << 21
SHARE, BLOCK, ROUNDS, RATE = 8_000_000, 500_000, 2, 0.15
STRETCH, BATCH = 256, 48  # tokens of a stretch, stretches of a batch
PIECE = 1 << 15  # tokens that go to a trainer together
EDGE = VOCABULARY - 1  # stands before and after a text; never a target
_PIECES = 16
_ONES = np.ones(max(CLASSES, WIDTH), np.float32)
_SHIFTS = [p for p in range(2 * SIDE + 1) if p != SIDE]  # of the neighbours, from the first one


def count_words(docs: DataFrame) -> DataFrame:
    """``h, n``: each word's hash and its count over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, counts = zip(*(np.unique(w.hash, return_counts=True) for w in _bytes.words(batch.column(0), _bytes.NOT_SPACE, _bytes.LOWER)), strict=True)
            keys, at = np.unique(np.concatenate(keys), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.bincount(at, np.concatenate(counts), len(keys)).astype(np.int64))], names=["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class Vocabulary:
    def __init__(self, hashes: list[int]):
        h = np.array(hashes, np.int64).view(np.uint64)
        order = np.argsort(h)
        self.keys, self.ids = h[order], order.astype(np.int32)

    def of(self, h: np.ndarray) -> np.ndarray:
        rare = (VOCABULARY - 1 - RARE + slot_of(h) % RARE).astype(np.int32)
        if not len(self.keys):
            return rare
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.ids[at], rare)


def slot_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(65 - SLOTS.bit_length())).astype(np.int64)


class Network:
    """Embeddings, a matrix for each place, class weights, word weights by class; and Adagrad's sums for each."""

    SHAPES = ((VOCABULARY, HIDDEN), (2 * SIDE, HIDDEN, HIDDEN), (HIDDEN + 1, CLASSES), (CLASSES, HIDDEN + 1, WIDTH))
    SHAPES += ((VOCABULARY,), *SHAPES[1:])

    def __init__(self, arrays: list[np.ndarray]):
        self.embed, self.places, self.classes, self.words, *self.past = arrays

    @classmethod
    def fresh(cls, frequency: np.ndarray | None = None, seed: int = 1) -> Network:
        """Small random weights; ``frequency`` of the entries gives the biases."""
        rng = np.random.default_rng(seed)
        net = cls([*(rng.normal(0, x, s).astype(np.float32) for x, s in zip((0.1, 0.1, 0.01, 0.01), cls.SHAPES, strict=False)), *(np.full(s, 1e-1, np.float32) for s in cls.SHAPES[4:])])
        net.places += np.eye(HIDDEN, dtype=np.float32)
        if frequency is not None:
            share = (frequency + 0.1).reshape(CLASSES, WIDTH)
            net.classes[HIDDEN] = np.log(share.sum(1) / share.sum())
            net.words[:, HIDDEN] = np.log(share / share.sum(1, keepdims=True))
        return net

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in (self.embed, self.places, self.classes, self.words, *self.past)])

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        out, at = [], 0
        for shape in cls.SHAPES:
            n = int(np.prod(shape))
            out.append(flat[at : at + n].reshape(shape).astype(np.float32).copy())
            at += n
        return cls(out)

    def hidden(self, stretches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings of rows of ids, and the hidden layer of all but the first and last SIDE of each row."""
        x = self.embed[stretches]
        n = stretches.shape[1] - 2 * SIDE
        total = x[:, _SHIFTS[0] : _SHIFTS[0] + n] @ self.places[0]
        for k, p in enumerate(_SHIFTS[1:], 1):
            total += x[:, p : p + n] @ self.places[k]
        return x, np.tanh(total, out=total)

    def log_probability(self, stretches: np.ndarray) -> np.ndarray:
        """Natural logarithms for all but the first and last SIDE ids of each row; 0 at EDGE."""
        flat = stretches[:, SIDE:-SIDE].ravel()
        order, c, word, bounds = self._by_class(flat)
        h = np.ones((len(order), HIDDEN + 1), np.float32)
        h[:, :HIDDEN] = self.hidden(stretches)[1].reshape(-1, HIDDEN)[order]
        rows = np.arange(len(order)) * CLASSES
        z = h @ self.classes
        got = z.ravel().take(rows + c)
        sums = np.exp(z, out=z) @ _ONES[:CLASSES]
        word += np.arange(len(order)) * WIDTH
        for k in np.flatnonzero(np.diff(bounds)):
            lo, hi = bounds[k], bounds[k + 1]
            z = h[lo:hi] @ self.words[k]
            got[lo:hi] += z.ravel().take(word[lo:hi] - lo * WIDTH)
            sums[lo:hi] *= np.exp(z, out=z) @ _ONES[:WIDTH]
        got -= np.log(sums)
        out = np.zeros(len(flat), np.float32)
        out[order] = got
        return out.reshape(len(stretches), -1)

    @staticmethod
    def _by_class(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of the targets by class, their classes, words within them, and the bounds of the classes."""
        some = np.flatnonzero(flat != EDGE)
        target = flat[some]
        by = np.argsort((target >> (WIDTH.bit_length() - 1)).astype(np.uint8), kind="stable")
        target = target[by].astype(np.intp)
        c = target >> (WIDTH.bit_length() - 1)
        return some[by], c, target & (WIDTH - 1), np.searchsorted(c, np.arange(CLASSES + 1))

    def train(self, stretches: np.ndarray, seed: int) -> None:
        """One pass of Adagrad over rows of ids, in random order."""
        order = np.random.default_rng(seed).permutation(len(stretches))
        for i in range(0, len(order), BATCH):
            self._step(stretches[order[i : i + BATCH]])
            for weights in (self.classes, self.words):  # so that exponentials need no shift
                np.clip(weights, -20, 20, out=weights)

    def _step(self, ids: np.ndarray) -> None:
        by_embed, by_place, by_class, by_word = self.past
        x, hidden = self.hidden(ids)
        some, c, word, bounds = self._by_class(ids[:, SIDE:-SIDE].ravel())
        if not len(some):
            return
        h = np.ones((len(some), HIDDEN + 1), np.float32)
        h[:, :HIDDEN] = hidden.reshape(-1, HIDDEN)[some]
        e = h @ self.classes
        np.exp(e, out=e)
        e *= (1 / (e @ _ONES[:CLASSES]))[:, None]
        e.ravel()[np.arange(len(some)) * CLASSES + c] -= 1
        back = e @ self.classes[:HIDDEN].T
        slope = h.T @ e
        by_class += slope * slope
        self.classes -= RATE * slope / np.sqrt(by_class)
        word += np.arange(len(some)) * WIDTH
        for k in np.flatnonzero(np.diff(bounds)):
            lo, hi = bounds[k], bounds[k + 1]
            own, weights = h[lo:hi], self.words[k]
            e = own @ weights
            np.exp(e, out=e)
            e *= (1 / (e @ _ONES[:WIDTH]))[:, None]
            e.ravel()[word[lo:hi] - lo * WIDTH] -= 1
            back[lo:hi] += e @ weights[:HIDDEN].T
            slope = own.T @ e
            by_word[k] += slope * slope
            weights -= RATE * slope / np.sqrt(by_word[k])
        back *= 1 - h[:, :HIDDEN] ** 2
        spread = np.zeros_like(hidden).reshape(-1, HIDDEN)
        spread[some] = back
        spread = spread.reshape(hidden.shape)
        n, down = hidden.shape[1], np.zeros_like(x)
        for k, p in enumerate(_SHIFTS):
            slope = x[:, p : p + n].reshape(-1, HIDDEN).T @ spread.reshape(-1, HIDDEN)
            down[:, p : p + n] += spread @ self.places[k].T
            by_place[k] += slope * slope
            self.places[k] -= RATE * slope / np.sqrt(by_place[k])
        at = ids.ravel().astype(np.uint16)
        by = np.argsort(at, kind="stable")  # of 16 bits: a radix sort
        at = at[by]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        slope = np.add.reduceat(down.reshape(-1, HIDDEN)[by], first)
        by_embed[at[first]] += (slope * slope).mean(1)
        self.embed[at[first]] -= RATE * slope / np.sqrt(by_embed[at[first]])[:, None]


def stretched(stream: np.ndarray, length: int = STRETCH) -> np.ndarray:
    """A stream with SIDE ids on either side, as rows of ``length`` ids and SIDE on either side of each; what
    the last row lacks is EDGE.
    """
    n = max(0, len(stream) - 2 * SIDE)
    rows = -(-n // length)
    full = np.full(rows * length + 2 * SIDE, EDGE, np.int16)
    full[: len(stream)] = stream
    return np.lib.stride_tricks.sliding_window_view(full, length + 2 * SIDE)[::length] if rows else np.zeros((0, length + 2 * SIDE), np.int16)


def streams(w: _bytes.Words, ids: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ids of the texts with SIDE times EDGE before, between and after them, in pieces of PIECE places and
    SIDE ids on either side; before them, which word stands at each place (-1: none).
    """
    if not len(ids):
        return [], []
    n = np.diff(w.of)
    n = n[n > 0]
    out = np.full(len(ids) + SIDE * (len(n) + 1), EDGE, np.int16)
    place = np.full(len(out), -1)
    at = np.arange(len(ids)) + SIDE * (np.repeat(np.arange(len(n)), n) + 1)
    out[at], place[at] = ids, np.arange(len(ids))
    cuts = [(i, min(i + PIECE, len(out) - SIDE)) for i in range(SIDE, len(out) - SIDE, PIECE)]
    return [place[i:j] for i, j in cuts], [out[i - SIDE : j + SIDE] for i, j in cuts]


def training_streams(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``n, stream``: pieces of the texts as int16 ids, and how many targets each has."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in _bytes.words(batch.column(0), _bytes.NOT_SPACE, _bytes.LOWER):
                for x in streams(w, sent.value.of(w.hash))[1]:
                    yield pa.RecordBatch.from_arrays([pa.array([int((x[SIDE:-SIDE] != EDGE).sum())], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["n", "stream"])

    return docs.select("text").mapInArrow(run, "n long, stream binary")


def slots(counts: DataFrame) -> np.ndarray:
    """How often the words of each slot stand: SLOTS numbers, whatever the corpus."""
    found = counts.groupBy(F.shiftrightunsigned("h", 65 - SLOTS.bit_length()).cast("int").alias("s")).agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.float64)
    out[found["s"].to_numpy()] = found["n"].to_numpy()
    return out


@dataclass
class Model:
    vocabulary: Vocabulary
    network: Network
    rare: np.ndarray  # log share of each slot in its entry

    def score(self, w: _bytes.Words) -> np.ndarray:
        """Log probability of each word."""
        ids = self.vocabulary.of(w.hash)
        out = np.zeros(len(ids))
        for place, stream in zip(*streams(w, ids), strict=True):
            rows = stretched(stream)
            for i in range(0, len(rows), BATCH):
                got = self.network.log_probability(rows[i : i + BATCH]).ravel()
                at = place[i * STRETCH : i * STRETCH + len(got)]
                out[at[at >= 0]] = got[: len(at)][at >= 0]
        beyond = ids >= VOCABULARY - 1 - RARE
        out[beyond] += self.rare[slot_of(w.hash[beyond])]
        return out


def train(docs: DataFrame) -> Model:
    spark = docs.sparkSession
    docs = docs.select("text")
    counts = written(count_words(docs), "counts")
    top = counts.orderBy(F.desc("n"), "h").limit(VOCABULARY - 1 - RARE).collect()
    vocabulary = Vocabulary([r.h for r in top])
    held = slots(counts.join(F.broadcast(spark.createDataFrame([(r.h,) for r in top], "h long")), "h", "left_anti"))
    entries = np.bincount(np.arange(SLOTS) % RARE, held, RARE)
    rare = (np.log(np.maximum(held, 1)) - np.log(entries + 1)[np.arange(SLOTS) % RARE]).astype(np.float32)
    frequency = np.zeros(VOCABULARY)
    frequency[: len(top)] = [r.n for r in top]
    frequency[VOCABULARY - 1 - RARE : EDGE] = entries
    flat = Network.fresh(frequency).flat()
    gathered = written(training_streams(docs, vocabulary), "streams")
    total = gathered.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    trainers = max(1, -(-total // SHARE))
    key = F.xxhash64("stream")
    # Round by round in turn, so that every trainer has as much to do.
    dealt = written(gathered.select("stream", F.pmod(key, F.lit(max(1, ROUNDS))).cast("int").alias("round")).repartition(trainers), "dealt")
    for round_ in range(ROUNDS if total else 0):
        sent = spark.sparkContext.broadcast(flat)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, round_=round_) -> Iterator[pa.RecordBatch]:
            net, held, n, seen = Network.of(sent.value), [], 0, 0
            for batch in batches:
                for x in batch.column(0).to_pylist():
                    held.append(stretched(np.frombuffer(x, np.int16)))
                    n += held[-1].size
                    if n >= BLOCK:
                        net.train(np.concatenate(held), round_)
                        seen, held, n = seen + n, [], 0
            if held:
                net.train(np.concatenate(held), round_)
                seen += n
            if seen:
                parts = np.array_split(net.flat(), _PIECES)
                yield pa.RecordBatch.from_arrays([pa.array(range(_PIECES), pa.int32()), pa.array([seen] * _PIECES, pa.int64()), pa.array([p.astype(np.float32).tobytes() for p in parts], pa.binary())], names=["piece", "n", "part"])

        trained = dealt.where(F.col("round") == round_).select("stream").mapInArrow(run, "piece int, n long, part binary")
        averaged = trained.groupBy("piece").applyInPandas(_average, "piece int, part binary").collect()  # the size of one network
        if averaged:
            flat = np.concatenate([np.frombuffer(r.part, np.float32) for r in sorted(averaged, key=lambda r: r.piece)])
    return Model(vocabulary, Network.of(flat), rare)


def _average(pdf):
    """One piece of the networks of all trainers, weighted by their windows."""
    import pandas as pd

    total = sum(np.frombuffer(x, np.float32).astype(np.float64) * n for x, n in zip(pdf["part"], pdf["n"], strict=True))
    return pd.DataFrame({"piece": pdf["piece"].iloc[:1], "part": [(total / pdf["n"].sum()).astype(np.float32).tobytes()]})


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (``doc_id``), ``n_tokens``, ``log_likelihood`` and ``mean_log_likelihood``."""
    keep = ["doc_id"] if keep is None else keep
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> dict[str, pa.Array]:
        n, total = [np.zeros(0, np.int64)], [np.zeros(0)]
        for w in _bytes.words(texts, _bytes.NOT_SPACE, _bytes.LOWER):
            n.append(np.diff(w.of))
            total.append(w.per_doc(sent.value.score(w)))
        return {"_n": pa.array(np.concatenate(n), pa.int64()), "_sum": pa.array(np.concatenate(total), pa.float64())}

    named = docs.select(*[docs[c].alias(f"_c{i}") for i, c in enumerate(keep)], docs["text"].alias("text"))
    scored = map_text(named, run, "_n long, _sum double", named.columns[:-1])
    columns = [F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)]
    return scored.select(*columns, F.col("_n").alias("n_tokens"), F.col("_sum").alias("log_likelihood"), F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n")).alias("mean_log_likelihood"))
