"""Toxicity by a support vector machine on a subsequence string kernel with Nystroem landmarks.

The kernel compares words by their gapped four-letter subsequences: a subsequence that spans s
places weighs ``DECAY ** (s - 4)``, up to ``SPAN`` places; word ends count as letters. Signs inside a
word are dropped and single letters that follow each other are read as one word, so gapped and
inserted-character spellings stay near the plain one. A Nystroem map onto landmark words gives the
features of a linear machine with squared hinge loss, solved on a working set: the hardest clean words
so far and a fixed share of all (``WORKING`` of each). Its decision is a weighted sum of kernels with
the landmarks, and folding the landmarks' subsequences into one weight table gives the same value in
time linear in the text.

A sentence is as toxic as its worst words, and a document as its worst sentences, which is the same
as the best ``BEST`` word scores of the text; a logistic curve on them, fitted on labelled rows that the
machine did not see, gives the probability. Training words come from labelled sentences: all words of
clean texts are clean; of a toxic text only its likeliest words are taken as witnesses, and these are
chosen anew after each fit, as are the clean words: the likeliest words of every clean text join the
``CONTROLS`` words that training starts from.

Bounds on labelled rows: ``TRAIN_ROWS`` documents by hash order, and of the toxic ones among them as many,
by hash order, as have ``CANDIDATES`` rare words together.

Defined cases: null or empty text scores as a text without words; without labels of both kinds every
score is the share of toxic labels (0 if none); of several labels of a document the largest holds;
extra columns are ignored, whatever their names; repeated rows are scored each; a text of any length is
scored whole, in blocks of texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reefline.llm import _bytes
from reefline.llm._frames import map_text, plain, written

TRAIN_ROWS, CONTROLS, CANDIDATES = 20_000, 40_000, 400_000
LANDMARKS, ROUNDS, WITNESSES, BEST = 768, 5, 3, 4
#: Rounds of the machine that only the curve is fitted on.
FIRST_ROUNDS = 3
#: Clean words that a fit takes: as many of the hardest, and as many of all.
WORKING = 16_000
#: Bits of the hash of a subsequence.
BITS = 20
#: Texts whose words are scored at once while training; bounds memory only.
TEXTS = 128
#: A word of toxic texts may be a witness if clean texts with it are fewer by this factor.
RARER = 8
#: Log likelihood ratio from which a word may be a first witness, and its share of the best in its text. Both look at the text
#: alone: a bar by the whole corpus is one that a language with few labelled texts never passes.
STANDS_OUT, NEAR_BEST = 12.0, 0.5
#: Letters of the runs that first witnesses are found by: stems show in the longer ones, other spellings in the short ones.
RUNS = (4, 7)
DECAY, SPAN, REGULAR = 0.5, 6, 1e-5
THRESHOLD = 0.3

_END, _DROP = 63, 64
_b = np.arange(256)
_SYMBOL = np.full(256, _DROP, np.uint8)
_SYMBOL[(_b >= 0x80) & (_b < 0xC0)] = 27 + (_b[(_b >= 0x80) & (_b < 0xC0)] & 31)
_SYMBOL[0x30:0x3A] = 26
for _first in (0x41, 0x61):
    _SYMBOL[_first : _first + 26] = np.arange(26)
_SYMBOL[~_bytes.NOT_SPACE] = _END
_STEPS = [(a, b, k) for k in range(3, SPAN) for b in range(2, k) for a in range(1, b)]


@dataclass
class Spelled:
    """Symbols of some texts with one end mark between words. ``ends[k]`` opens word k."""

    symbols: np.ndarray
    ends: np.ndarray
    of: np.ndarray  # first word of each text, and the number of words

    def lengths(self) -> np.ndarray:
        return np.diff(self.ends) - 1


def spell(data: np.ndarray, bounds: np.ndarray) -> Spelled:
    s = np.insert(_SYMBOL[data], bounds, _END)
    fixed = np.zeros(len(s), bool)
    fixed[bounds + np.arange(len(bounds))] = True
    keep = s != _DROP
    s, fixed = s[keep], fixed[keep]
    end = s == _END
    before = np.concatenate(([False], end[:-1]))
    near_fixed = np.concatenate((fixed[1:], [False]))
    keep = ~end | fixed | ~before & ~near_fixed  # of neighbouring marks one stays, a text's own if there is one
    s, fixed = s[keep], fixed[keep]
    end = s == _END
    if len(s) > 4:  # single letters in a row
        mid = np.zeros(len(s), bool)
        mid[2:-2] = end[2:-2] & end[:-4] & end[4:] & ~end[1:-3] & ~end[3:-1] & ~fixed[2:-2]
        s, fixed = s[~mid], fixed[~mid]
        end = s == _END
    ends = np.flatnonzero(end)
    own = np.searchsorted(ends, np.flatnonzero(fixed))
    # Marks that touch (empty texts) open no word; such a word has length zero and stays harmless.
    return Spelled(s, ends, own)


def chunks(column: pa.Array) -> Iterator[tuple[int, Spelled]]:
    data, offsets = _bytes.buffers(column)
    for i, j in _bytes.chunks(offsets):
        yield i, spell(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _subsequences(s: Spelled) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each gap pattern: the places it holds at, the subsequences there, and their weight."""
    n = len(s.symbols)
    stop = np.repeat(s.ends[1:], np.diff(s.ends))  # the mark that closes the word of each place
    room = stop - np.arange(len(stop))
    c = s.symbols.astype(np.uint32)
    for a, b, k in _STEPS:
        if n <= k:
            continue
        ok = np.flatnonzero(room[: n - k] >= k)
        key = (c[ok] << 18) | (c[ok + a] << 12) | (c[ok + b] << 6) | c[ok + k]
        yield ok, (key * np.uint32(2654435761)) >> np.uint32(32 - BITS), DECAY ** (k - 3)


def _norm(lengths: np.ndarray) -> np.ndarray:
    total = sum(DECAY ** (2 * (k - 3)) * np.maximum(0, lengths + 2 - k) for _, _, k in _STEPS)
    return np.sqrt(np.maximum(total, 1e-9))


def word_scores(s: Spelled, table: np.ndarray) -> np.ndarray:
    if len(s.ends) < 2:
        return np.zeros(0, np.float32)
    gained = np.zeros(len(s.symbols), np.float32)
    for at, which, weight in _subsequences(s):
        gained[at] += table[which] * np.float32(weight)
    return np.add.reduceat(gained, s.ends[:-1]) / _norm(s.lengths())


def best(s: Spelled, scores: np.ndarray, floor: float, n: int = BEST) -> np.ndarray:
    """The ``n`` largest word scores of each text, from the top; ``floor`` where it has fewer words."""
    out = np.full((len(s.of) - 1, n), floor)
    real = np.flatnonzero(s.lengths() > 0)
    scores, doc = np.maximum(scores[real], floor), np.repeat(np.arange(len(s.of) - 1), np.diff(s.of))[real]
    for k in range(n):
        if not len(scores):
            break
        np.maximum.at(out[:, k], doc, scores)
        hit = np.flatnonzero(scores == out[doc, k])
        first = hit[np.unique(doc[hit], return_index=True)[1]]  # one place of each maximum is taken out
        scores, doc = np.delete(scores, first), np.delete(doc, first)
    return out


@dataclass
class Model:
    table: np.ndarray
    floor: float
    curve: np.ndarray  # a weight for each of the best scores, and a constant

    def best(self, column: pa.Array) -> np.ndarray:
        return np.concatenate([np.zeros((0, BEST)), *(best(s, word_scores(s, self.table), self.floor) for _, s in chunks(column))])

    def score(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.best(column) @ self.curve[:-1] + self.curve[-1], -40, 40)))


def _spell_words(words: list[str]) -> Spelled:
    data, offsets = _bytes.buffers(pa.array(words, pa.large_string()))
    return spell(data, offsets - offsets[0])


def _rows(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, subsequence and normalised weight of every subsequence of the words."""
    s = _spell_words(words)
    doc = np.repeat(np.arange(len(s.of) - 1), np.diff(s.of))
    of_place = np.repeat(np.arange(len(s.ends) - 1), np.diff(s.ends))
    norm = _norm(s.lengths())
    row, which, weight = [], [], []
    for at, w, x in _subsequences(s):
        k = of_place[at]
        row.append(doc[k])
        which.append(w)
        weight.append(x / norm[k])
    return np.concatenate(row), np.concatenate(which), np.concatenate(weight).astype(np.float32)


def kernel(words: list[str], landmarks: list[str], step: int = 4000) -> np.ndarray:
    row, which, weight = _rows(landmarks)
    known, at = np.unique(which, return_inverse=True)
    dense = np.zeros((len(known), len(landmarks)), np.float32)
    np.add.at(dense, (at, row), weight)
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for i in range(0, len(words), step):
        row, which, weight = _rows(words[i : i + step])
        at = np.searchsorted(known, which)
        at[at == len(known)] = 0
        hit = known[at] == which
        row, at, weight = row[hit], at[hit], weight[hit]
        order = np.argsort(row, kind="stable")
        row, at, weight = row[order], at[order], weight[order]
        lo = 0
        while lo < len(row):  # whole words, about 16,000 subsequences
            hi = len(row) if lo + 16_000 >= len(row) else max(int(np.searchsorted(row, row[lo + 16_000])), int(np.searchsorted(row, row[lo], "right")))
            own, first = np.unique(row[lo:hi], return_index=True)
            out[i + own] = np.add.reduceat(dense[at[lo:hi]] * weight[lo:hi, None], first)
            lo = hi
    return out


def features(words: list[str], landmarks: list[str], root: np.ndarray, step: int = 4000) -> np.ndarray:
    """The Nystroem map of the words, made block by block."""
    out = np.empty((len(words), root.shape[1]), np.float32)
    for i in range(0, len(words), step):
        out[i : i + step] = kernel(words[i : i + step], landmarks) @ root
    return out


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, step: int = 4096) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps; rows are taken in blocks."""
    d = x.shape[1] + 1
    w = np.zeros(d)
    ridge = REGULAR * weight.sum() * np.eye(d)
    ridge[-1, -1] = 1e-6
    for _ in range(25):
        square, right = ridge.copy(), np.zeros(d)
        for i in range(0, len(x), step):
            block = np.column_stack((x[i : i + step], np.ones(len(x[i : i + step]), np.float32)))
            on = y[i : i + step] * (block @ w.astype(np.float32)) < 1
            block = block[on]
            scaled = block * weight[i : i + step][on, None].astype(np.float32)
            square += scaled.T @ block
            right += scaled.T @ y[i : i + step][on].astype(np.float32)
        new = np.linalg.solve(square, right)
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _enrichment(words: list[str], in_docs: np.ndarray, controls: list[str]) -> np.ndarray:
    """First guess of how toxic a word of a toxic text is: how far its oddest run of letters stands out.

    A letter run's count over the words of toxic texts is held against what the controls let expect,
    as a Poisson log likelihood ratio.
    """
    runs = lambda w: {f"^{w}$"[i : i + k] for k in RUNS for i in range(len(w) + 3 - k)}
    seen: Counter[str] = Counter()
    for w, n in zip(words, in_docs.tolist(), strict=True):
        for r in runs(w):
            seen[r] += n
    usual = Counter(r for w in controls for r in runs(w))
    share = int(in_docs.sum()) / len(controls)

    def odd(n: int, e: float) -> float:
        return n * np.log(n / e) - (n - e) if n > e else 0.0

    value = {r: odd(n, share * (usual[r] + 0.5)) for r, n in seen.items()}
    return np.array([max((value[r] for r in runs(w)), default=0.0) for w in words])


def _curve(constant: float, first: float = 0.0) -> np.ndarray:
    return np.array([first, *[0.0] * (BEST - 1), constant])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", seed: int = 5) -> Model:
    """A model from the labelled documents among ``docs``; ``labels`` has doc_id and the label."""
    flat = Model(np.zeros(1 << BITS, np.float32), -1.0, _curve(-40.0))
    spark = docs.sparkSession
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(TRAIN_ROWS)
    rows = chosen.select(F.col("doc_id").cast("string").alias("i"), "_y", (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).alias("late")).collect()
    truth = {r.i: int(r["_y"]) for r in rows}
    if len(set(truth.values())) < 2:
        share = sum(truth.values()) / max(1, len(truth))
        return Model(flat.table, -1.0, _curve(float(np.log(max(share, 1e-17) / max(1 - share, 1e-17)))))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "_y", (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).alias("_late"))  # TRAIN_ROWS rows at most
    lists = written(map_text(sample, lambda t: {"words": _word_lists(t)}, "words array<string>", ["doc_id", "_y", "_late"]), "words")
    first = _fit(lists.where("NOT _late"), seed, FIRST_ROUNDS)
    if first is None:
        return flat
    table, bias, floor = first
    sent = spark.sparkContext.broadcast(Model(table, floor, _curve(0.0)))
    late = map_text(sample.where("_late"), lambda t: {"x": pa.array(sent.value.best(t).tolist(), pa.list_(pa.float64()))}, "x array<double>", ["_y"]).collect()
    # The curve comes from texts the first machine has not seen, the machine itself from all of them.
    table, bias, floor = _fit(lists, seed) or first
    model = Model(table, floor, _curve(4.0 * bias, 4.0))
    if len({r["_y"] for r in late}) < 2:
        return model
    x, y = np.array([r.x for r in late]), np.array([r["_y"] for r in late], float)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    c = _logistic((x - mean) / scale, y)
    model.curve = np.append(c[:-1] / scale, c[-1] - (c[:-1] * mean / scale).sum())
    return model


def _fit(lists: DataFrame, seed: int, rounds: int = ROUNDS) -> tuple[np.ndarray, float, float] | None:
    """The weight table, the bias and the least score of a machine on the words of some labelled texts (doc_id, _y, words); None
    without words of both kinds.
    """
    spark = lists.sparkSession
    pairs = lists.select("doc_id", "_y", F.explode("words").alias("w"))
    seen = pairs.groupBy("w").agg(F.count_if(F.col("_y") == 0).alias("clean"), F.count_if(F.col("_y") == 1).alias("toxic"))
    rare = f"{RARER} * clean <= toxic"
    controls = seen.where(f"NOT ({rare})").orderBy(F.xxhash64("w"), "w").select("w").limit(CONTROLS).toArrow()["w"].to_pylist()
    held = pairs.where("_y = 1").join(seen.where(rare).select("w"), "w").select("doc_id", "w")
    of = held.groupBy("doc_id").count().select(F.col("doc_id").cast("string").alias("i"), "count").orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # TRAIN_ROWS rows at most
    total, taken = 0, []
    for r in of:  # whole texts, one at least
        total += r["count"]
        if taken and total > CANDIDATES:
            break
        taken.append((r.i,))
    taken = spark.createDataFrame(taken, "_i string")
    held = held.join(F.broadcast(taken), F.col("doc_id").cast("string") == F.col("_i")).select("doc_id", "w").orderBy(F.xxhash64("doc_id"), "doc_id", "w").toArrow()
    coded = held["w"].combine_chunks().dictionary_encode()
    candidates = coded.dictionary.to_pylist()
    if not candidates or not controls:
        return None
    doc, word = np.unique(held["doc_id"].to_numpy(), return_inverse=True)[1], coded.indices.to_numpy()
    in_docs = np.bincount(word, minlength=len(candidates))
    rng = np.random.default_rng(seed)
    odd = _enrichment(candidates, in_docs, controls)
    scores, own_best = odd, np.zeros(int(doc.max()) + 1)
    np.maximum.at(own_best, doc, odd[word])
    sure = np.zeros(len(candidates), bool)
    sure[word[odd[word] >= np.maximum(STANDS_OUT, NEAR_BEST * own_best[doc])]] = True
    control_scores = np.zeros(len(controls))
    for turn in range(rounds):
        order = np.lexsort((word, -scores[word], doc))
        rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
        found = np.unique(word[order][rank < WITNESSES])  # the likeliest words of each toxic text
        found = found[scores[found] > 0] if turn else found[sure[found]] if sure.any() else found
        if not len(found):
            break
        found = found[np.argsort(-in_docs[found] - scores[found] / (1 + np.abs(scores[found])), kind="stable")]
        hard = np.argsort(-control_scores, kind="stable")[: LANDMARKS // 4] if turn else rng.permutation(len(controls))[: LANDMARKS // 4]
        spread = found[rng.permutation(len(found))[: LANDMARKS // 4]]
        marks = [candidates[i] for i in np.union1d(found[: LANDMARKS // 2], spread)] + [controls[i] for i in hard]
        value, vector = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
        good = value > 1e-6 * value[-1]
        root = (vector[:, good] / np.sqrt(value[good])).astype(np.float32)
        positive = [candidates[i] for i in found]
        hardest = np.argsort(-control_scores, kind="stable")[:WORKING] if turn else np.zeros(0, np.int64)
        negative = [controls[i] for i in np.union1d(hardest, rng.permutation(len(controls))[:WORKING])]
        x = features(positive + negative, marks, root)
        y = np.concatenate((np.ones(len(positive)), -np.ones(len(negative))))
        weight = np.where(y > 0, 0.5 / len(positive), 0.5 / len(negative)) * len(y)
        w, bias = _machine(x, y, weight)
        del x
        beta = root @ w
        row, which, share = _rows(marks)
        table = np.bincount(which, share * beta[row], 1 << BITS).astype(np.float32)
        if turn + 1 < rounds:  # the likeliest words of every clean text are clean all the same
            known = {*controls, *candidates}
            top = lists.where("_y = 0").select("words").mapInArrow(_top_words(table), "w string").distinct()
            controls += sorted(w for w in top.toArrow()["w"].to_pylist() if w not in known)  # WITNESSES a sampled text at most
        scores = _score_list(candidates, table) + bias
        control_scores = _score_list(controls, table) + bias
    if not control_scores.any():
        return None
    return table, bias, float(min(control_scores.min(), -1.0)) - bias


def _score_list(words: list[str], table: np.ndarray, step: int = 20_000) -> np.ndarray:
    out = [np.zeros(0)]
    for i in range(0, len(words), step):
        s = _spell_words(words[i : i + step])
        out.append(best(s, word_scores(s, table), -1e9, 1)[:, 0])
    return np.concatenate(out)


def _words_of(text: str | None) -> set[str]:
    """Distinct words as the kernel sees them: letters and digits only, lower case, single letters in a row
    as one word; of two signs at least.
    """
    found, single = set(), ""
    for run in (text or "").lower().split():
        w = run if run.isalpha() else "".join(c for c in run if c.isalnum())
        if len(w) > 1:
            found.add(w)
        if len(w) == 1:
            single += w
        elif w and single:
            found.add(single)
            single = ""
    found.add(single)
    return {w for w in found if len(w) > 1}


def _word_lists(texts: pa.Array) -> pa.Array:
    """The distinct words of each text; a few texts at a time are Python objects."""
    kind = pa.list_(pa.string())
    parts = [pa.array([sorted(_words_of(x)) for x in texts.slice(i, TEXTS).to_pylist()], kind) for i in range(0, len(texts), TEXTS)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def _top_words(table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                lists = batch.column(0).slice(lo, TEXTS)
                words = lists.flatten().to_pylist()
                if not words:
                    continue
                n = lists.value_lengths().fill_null(0).to_numpy()
                doc, got = np.repeat(np.arange(len(n)), n), _score_list(words, table)
                order = np.lexsort((-got, doc))
                rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
                yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in order[rank < WITNESSES]], pa.string())], names=["w"])

    return run


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Columns ``keep`` (``doc_id``) and ``score``, the probability that a text (in the column ``text``) is toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return map_text(docs, lambda t: {"score": pa.array(sent.value.score(t), pa.float64())}, "score double", ["doc_id"] if keep is None else keep, text)


def remove_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that score below the threshold."""
    named, back = plain(docs)
    names = [c for c in named.columns if c.startswith("_c")]
    return back(score(named, model, names, names[docs.columns.index("text")]).where(F.col("score") < threshold))
