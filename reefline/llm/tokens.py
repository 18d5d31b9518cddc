"""Token ids of whole text columns with a word-end BPE, each distinct word encoded once.

The public tokenizer splits at white space and between letters and other signs before it merges, so
a text's ids are the ids of its parts one after the other. Parts are cut with byte masks, met again
by a 64-bit hash in a cache of the worker process, and only unseen parts go through the tokenizer.
The cache starts anew beyond ``CACHE`` parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from reefline.llm import _bytes

CACHE = 1_500_000
_b = np.arange(256)
_LETTER = ((_b | 0x20) >= 0x61) & ((_b | 0x20) <= 0x7A) & (_b < 0x80)
_SIGN = (_b > 0x20) & (_b < 0x7F) & ~_LETTER & ~((_b >= 0x30) & (_b <= 0x39)) & (_b != 0x27)
_own: dict[str, WordIds] = {}


class WordIds:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    @classmethod
    def of(cls, path: str) -> WordIds:
        if path not in _own:
            _own[path] = cls(path)
        return _own[path]

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)  # in self.first
        self.first = [np.zeros(1, np.int64)]  # start of each part's ids, by block
        self.ids = np.zeros(0, np.int32)
        self.offset = np.zeros(1, np.int64)

    def encode(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts and how many each has."""
        texts = [p.decode("utf-8", "replace") for p in parts]
        simple = [t.isalpha() and max(t) < "ɐ" and "İ" not in t for t in texts]  # lower case makes two signs of a dotted capital I
        out: list[list[int] | None] = [None] * len(texts)
        plain = [i for i, s in enumerate(simple) if s]
        rest = [i for i, s in enumerate(simple) if not s]
        for k in range(0, len(plain), 2000):
            some = plain[k : k + 2000]
            ids = self.tokenizer.encode(" ".join(texts[i] for i in some), add_special_tokens=False).ids
            cut = np.flatnonzero(self.ends[np.array(ids, np.int64)]) + 1
            if len(cut) != len(some):  # the tokenizer makes several words of one: each by itself
                rest += some
                continue
            lo = 0
            for i, hi in zip(some, cut.tolist(), strict=True):
                out[i] = ids[lo:hi]
                lo = hi
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        n = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter((x for ids in out for x in ids), np.int32, int(n.sum())), n

    def words(self, w: _bytes.Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words of a chunk, and the bounds of its texts in them."""
        keys, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE:
            self.clear()
        pos = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = pos < len(self.keys)
        known[inside] = self.keys[pos[inside]] == keys[inside]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            data = w.data.tobytes()
            ids, n = self.encode([data[a:b] for a, b in zip(w.starts[at[fresh]].tolist(), w.ends[at[fresh]].tolist(), strict=True)])
            row = len(self.offset) - 1 + np.arange(len(fresh))
            self.offset = np.concatenate((self.offset, self.offset[-1] + np.cumsum(n)))
            self.ids = np.concatenate((self.ids, ids))
            self.keys = np.insert(self.keys, pos[fresh], keys[fresh])
            self.place = np.insert(self.place, pos[fresh], row)
            pos = np.searchsorted(self.keys, keys)
        row = self.place[pos][back]
        first, n = self.offset[row], self.offset[row + 1] - self.offset[row]
        total = np.concatenate(([0], np.cumsum(n)))
        return self.ids[np.repeat(first - total[:-1], n) + np.arange(total[-1])], total[w.of]


def texts(column: pa.Array, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Chunks of texts: index of the first, ids, bounds of each text in them."""
    own = WordIds.of(path)
    data, offsets = _bytes.buffers(column)
    for i, j in _bytes.chunks(offsets):
        part = _bytes.LOWER[data[offsets[i] : offsets[j]]]
        letter, sign = _LETTER[part], _SIGN[part]
        cut = np.zeros(len(part), bool)
        cut[1:] = letter[1:] & sign[:-1] | sign[1:] & letter[:-1]
        ids, bounds = own.words(_bytes.split(part, offsets[i : j + 1] - offsets[i], _bytes.NOT_SPACE, i, cut))
        yield i, ids, bounds
