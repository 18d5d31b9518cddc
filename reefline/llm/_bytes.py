"""Word boundaries and word hashes of whole Arrow string columns, with numpy on the UTF-8 bytes.

A text column arrives as one byte buffer with offsets. Masks over the bytes give the words of all
texts at once, and one running sum of a polynomial gives a 64-bit hash of each word, so no Python
object is made for a word. Texts are taken in chunks of about ``CHUNK`` bytes; a longer text is a
chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

_b = np.arange(256)
#: All bytes but white space (space, and tab to carriage return).
NOT_SPACE = ~((_b == 0x20) | ((_b >= 0x09) & (_b <= 0x0D)))
#: Digits, ASCII letters and every byte of a character beyond ASCII.
ALNUM = ((_b >= 0x30) & (_b <= 0x39)) | ((_b | 0x20) >= 0x61) & ((_b | 0x20) <= 0x7A) & (_b < 0x80) | (_b >= 0x80)
#: A-Z to a-z.
LOWER = np.where((_b >= 0x41) & (_b <= 0x5A), _b + 32, _b).astype(np.uint8)
SAME = _b.astype(np.uint8)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * CHUNK)
        for k, base in enumerate((_ODD, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@dataclass
class Words:
    """Words of the texts ``first`` to ``first + len(bounds) - 2`` of a column."""

    first: int
    data: np.ndarray  # folded bytes of these texts
    bounds: np.ndarray  # of the texts in data
    starts: np.ndarray
    ends: np.ndarray
    of: np.ndarray  # index of the first word of each text, and the number of words at the end
    hash: np.ndarray

    @property
    def n(self) -> int:
        return len(self.bounds) - 1

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.of))

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value of each word by text."""
        total = np.concatenate(([0], np.cumsum(values)))
        return total[self.of[1:]] - total[self.of[:-1]]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together, one text at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(column: pa.Array, keep: np.ndarray, fold: np.ndarray = SAME, size: int = CHUNK) -> Iterator[Words]:
    data, offsets = buffers(column)
    for i, j in chunks(offsets, size):
        part = fold[data[offsets[i] : offsets[j]]]
        yield split(part, offsets[i : j + 1] - offsets[i], keep, i)


def split(part: np.ndarray, bounds: np.ndarray, keep: np.ndarray, first: int = 0, cut: np.ndarray | None = None) -> Words:
    """``cut``: places where a word also ends, as a mask over the bytes (the byte starts a word)."""
    n = len(part)
    inside = keep[part]
    fresh = np.zeros(n + 1, bool)
    fresh[bounds] = True
    if cut is not None:
        fresh[:n] |= cut
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (fresh[:n] | ~before))
    after = np.zeros(n, bool)
    after[: n - 1] = inside[1:]
    ends = np.flatnonzero(inside & (fresh[1:] | ~after)) + 1
    power, inverse = _powers_to(n + 1)
    run = np.empty(n + 1, np.uint64)
    run[0] = 0
    np.cumsum(_VALUES[part] * power[:n], out=run[1:])
    return Words(first, part, bounds, starts, ends, np.searchsorted(starts, bounds), mix((run[ends] - run[starts]) * inverse[starts]))
