"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Features of a document are its word occurrences (hashed to ``2 ** BITS`` buckets, each weighing
1 / sqrt of the word count), structure statistics of the text, and the recorded length. The machine
adds a bias, a linear term and all pairwise products of features through ``FACTORS``-dimensional
vectors; the pairs cost linear time by the identity 2 * sum_ij <v_i, v_j> x_i x_j =
|sum_i v_i x_i|^2 - sum_i |v_i|^2 x_i^2.

It is trained with Adagrad on labelled rows taken by hash order: at most ``TRAIN_ROWS``, and as many of
them as have ``TRAIN_WORDS`` words together, which bounds what reaches the driver.

Defined cases: null or empty text has no words and statistics of zero; a null ``n_chars`` counts as
the text's own length; without labels of both kinds every score is the share of label 1 (0.5 if there
are none); of several labels of a document the smallest holds; extra columns are ignored, whatever
their names; repeated rows are scored each; texts of any length are scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reefline.llm import _bytes
from reefline.llm._frames import map_text, written

BITS, FACTORS, TRAIN_ROWS, TRAIN_WORDS = 16, 8, 20_000, 16_000_000
EPOCHS, BATCH, RATE, RIDGE = 6, 128, 0.08, 1e-5
THRESHOLD = 0.7

_b = np.arange(256)
_UPPER = (_b >= 0x41) & (_b <= 0x5A)
_LETTER = ((_b | 0x20) >= 0x61) & ((_b | 0x20) <= 0x7A) & (_b < 0x80) | (_b >= 0xC0)
_DIGIT = (_b >= 0x30) & (_b <= 0x39)
_MARKS = [np.isin(_b, list(map(ord, x))) for x in ("#*$%&<>", "|", "!", ".", ",", "\n")]
STATISTICS = ("log_words", "word_length", "distinct", "repeated_next", "capitals", "letters", "digits", *(f"mark_{i}" for i in range(len(_MARKS))), "log_chars")


def _per_text(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask)))
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(float)


def features(column: pa.Array, n_chars: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words, bounds of the texts in them, and the statistics of each text."""
    buckets, counts, stats = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)], [np.zeros((0, len(STATISTICS)))]
    for w in _bytes.words(column, _bytes.NOT_SPACE):
        n = np.diff(w.of)
        words = np.maximum(1, n).astype(float)
        doc = w.doc()
        order = np.lexsort((w.hash, doc))
        h, d = w.hash[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        same = np.zeros(len(h), bool)
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
        size = np.maximum(1, np.diff(w.bounds)).astype(float)
        letters = np.maximum(1, _per_text(_LETTER[w.data], w.bounds))
        chars = np.diff(w.bounds).astype(float) if n_chars is None else n_chars[w.first : w.first + w.n]
        rows = [
            np.log1p(n), w.per_doc(w.ends - w.starts) / words, np.bincount(d[new], minlength=w.n) / words, w.per_doc(same) / words,
            _per_text(_UPPER[w.data], w.bounds) / letters, letters / size, _per_text(_DIGIT[w.data], w.bounds) / size,
            *(np.minimum(4, _per_text(m[w.data], w.bounds) / words) for m in _MARKS), np.log1p(np.where(np.isnan(chars), size, np.maximum(chars, 0))),
        ]
        buckets.append((w.hash >> np.uint64(64 - BITS)).astype(np.uint16))
        counts.append(n)
        stats.append(np.column_stack(rows))
    n = np.concatenate(counts)
    return np.concatenate(buckets), np.concatenate(([0], np.cumsum(n))), np.concatenate(stats)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of rows by text, zero where a text has none."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), values.dtype)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = np.add.reduceat(values, bounds[some])
    return out


@dataclass
class Machine:
    bias: float
    word: np.ndarray  # linear weights of the buckets
    factor: np.ndarray  # their vectors
    stat: np.ndarray
    stat_factor: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def standard(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -5, 5).astype(np.float32)

    def margin(self, buckets: np.ndarray, bounds: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Decision values, the summed vectors, and the weight of each text's words."""
        unit = (1 / np.sqrt(np.maximum(1, np.diff(bounds)))).astype(np.float32)
        v = self.factor[buckets]
        total = _sums(v, bounds) * unit[:, None] + x @ self.stat_factor
        own = _sums((v * v).sum(1), bounds) * unit**2 + (x * x) @ (self.stat_factor**2).sum(1)
        linear = _sums(self.word[buckets], bounds) * unit + x @ self.stat
        return self.bias + linear + 0.5 * ((total * total).sum(1) - own), total, unit

    def score(self, column: pa.Array, n_chars: np.ndarray) -> np.ndarray:
        buckets, bounds, stats = features(column, n_chars)
        out = np.zeros(len(stats))
        for i in range(0, len(stats), 512):
            j = min(i + 512, len(stats))
            part = buckets[bounds[i] : bounds[j]]
            out[i:j] = self.margin(part, bounds[i : j + 1] - bounds[i], self.standard(stats[i:j]))[0]
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def _flat(share: float) -> Machine:
    zero = np.zeros(len(STATISTICS), np.float32)
    odds = float(np.log(max(share, 1e-12) / max(1 - share, 1e-12)))
    return Machine(odds, np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS, FACTORS), np.float32), zero, np.zeros((len(STATISTICS), FACTORS), np.float32), zero.astype(float), zero + 1.0)


def fit(buckets: list[np.ndarray], stats: np.ndarray, y: np.ndarray, seed: int = 3) -> Machine:
    if len(set(y.tolist())) < 2:
        return _flat(float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    m = _flat(float(y.mean()))
    m.mean, m.scale = stats.mean(0), stats.std(0) + 1e-6
    m.factor = rng.normal(0, 0.02, m.factor.shape).astype(np.float32)
    m.stat_factor = rng.normal(0, 0.05, m.stat_factor.shape).astype(np.float32)
    x = m.standard(stats)
    past = [np.full_like(a, 1e-2) for a in (m.word, m.factor, m.stat, m.stat_factor)]
    past_bias = 1e-2
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            ids = np.concatenate([buckets[k] for k in some]).astype(np.int64)
            bounds = np.concatenate(([0], np.cumsum([len(buckets[k]) for k in some])))
            xs = x[some]
            f, total, unit = m.margin(ids, bounds, xs)
            g = ((1 / (1 + np.exp(-np.clip(f, -40, 40))) - y[some]) / len(some)).astype(np.float32)
            n = np.diff(bounds)
            rows, at = np.unique(ids, return_inverse=True)
            per_word = np.repeat(g * unit, n)
            slopes = [np.bincount(at, per_word, len(rows)).astype(np.float32) + RIDGE * m.word[rows]]
            pull = np.repeat(total * (g * unit)[:, None], n, axis=0)
            own = np.bincount(at, np.repeat(g * unit**2, n), len(rows)).astype(np.float32)
            pairs = np.column_stack([np.bincount(at, pull[:, k], len(rows)) for k in range(FACTORS)]).astype(np.float32) if len(rows) else np.zeros((0, FACTORS), np.float32)
            slopes.append(pairs - own[:, None] * m.factor[rows] + RIDGE * m.factor[rows])
            slopes.append(xs.T @ g + RIDGE * m.stat)
            slopes.append(xs.T @ (total * g[:, None]) - ((xs * xs).T @ g)[:, None] * m.stat_factor + RIDGE * m.stat_factor)
            for k, (a, slope) in enumerate(zip((m.word, m.factor), slopes, strict=False)):
                past[k][rows] += slope**2
                a[rows] -= RATE * slope / np.sqrt(past[k][rows])
            for k, (a, slope) in enumerate(zip((m.stat, m.stat_factor), slopes[2:], strict=True), 2):
                past[k] += slope**2
                a -= RATE * slope / np.sqrt(past[k])
            past_bias += float(g.sum()) ** 2
            m.bias -= RATE * float(g.sum()) / past_bias**0.5
    return m


def _chars(batch: pa.Array) -> np.ndarray:
    return batch.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _with_length(docs: DataFrame) -> DataFrame:
    """Text and recorded length as one column, so that both reach the executors together."""
    n = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select(*[c for c in docs.columns if c != "_doc"], F.struct(F.coalesce("text", F.lit("")).alias("t"), n.alias("n")).alias("_doc"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", seed: int = 5) -> Machine:
    """A machine from the labelled documents among ``docs``; ``labels`` has doc_id and the label."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("double").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(TRAIN_ROWS)
    own = docs.select(*[c for c in docs.columns if c in ("doc_id", "text", "n_chars")])
    sample = _with_length(own.join(F.broadcast(chosen), "doc_id"))  # TRAIN_ROWS rows at most

    def run(column: pa.Array) -> dict[str, pa.Array]:
        buckets, bounds, stats = features(column.field("t"), _chars(column.field("n")))
        return {"buckets": pa.array([buckets[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()), "stats": pa.array(stats.tolist(), pa.list_(pa.float64()))}

    held = written(map_text(sample, run, "buckets binary, stats array<double>", ["doc_id", "_y"], "_doc").withColumn("_k", F.xxhash64("doc_id", F.lit(seed))), "features")
    words, last = 0, None
    for r in held.groupBy("_k").agg(F.sum(F.octet_length("buckets") / 2).alias("n")).orderBy("_k").collect():
        words += r.n
        if words > TRAIN_WORDS and last is not None:
            break
        last = r["_k"]
    rows = held.where(F.col("_k") <= F.lit(last)).collect() if last is not None else []
    rows.sort(key=lambda r: (r["_k"], r.doc_id, r.buckets))
    stats = np.array([r.stats for r in rows]).reshape(-1, len(STATISTICS))
    return fit([np.frombuffer(r.buckets, np.uint16) for r in rows], stats, np.array([r["_y"] for r in rows]))


def score(docs: DataFrame, machine: Machine, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (``doc_id``) and ``score``, the probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    run = lambda c: {"score": pa.array(sent.value.score(c.field("t"), _chars(c.field("n"))), pa.float64())}
    return map_text(_with_length(docs), run, "score double", ["doc_id"] if keep is None else keep, "_doc")
