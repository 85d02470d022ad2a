"""Words, word hashes and window hashes of Arrow text columns, in numpy.

A word is a run of characters other than space and U+0009 to U+000D. Words are
identified by 64-bit hashes of their UTF-8 bytes; work is done in slices of
about ``SLICE_BYTES`` so that memory follows the slice, not the batch. A null
text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

_IS_SEP = np.zeros(256, bool)
_IS_SEP[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII characters that are neither letters nor digits end a term.
_NO_TERM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: What stays of the eight bytes at a place of which so many belong to the word.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_PLACE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A copy of 64-bit values, well mixed."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """The words of consecutive texts.

    Word i has ``data[starts[i]:ends[i]]`` and ``hashes[i]``; text j has the words
    ``first[j]:first[j + 1]`` and the bytes ``offsets[j]:offsets[j + 1]``.
    """

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def _hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each word: its blocks of eight bytes, each mixed with its place, are summed with its length.

    Mixing is not linear, so no pattern within words makes their hashes equal, and a very long
    word costs as much for each byte as others.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    sizes = ends - starts
    sums = mix((eight[starts] & _KEEP[np.minimum(sizes, 8)]) + _PLACE)
    long = np.flatnonzero(sizes > 8)
    if len(long):
        blocks = (sizes[long] - 1) // 8
        owner = np.repeat(np.arange(len(long)), blocks)
        first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
        k = np.arange(len(owner)) - first[owner] + 1
        left = np.minimum(sizes[long][owner] - 8 * k, 8)
        more = mix((eight[starts[long][owner] + 8 * k] & _KEEP[left]) + _PLACE * (k + 1).astype(np.uint64))
        sums[long] += np.add.reduceat(more, first)
    return mix(sums ^ sizes.astype(np.uint64) * _PLACE)


def of_bytes(data: np.ndarray, offsets: np.ndarray, lower: bool = False, terms: bool = False) -> Words:
    """Words of the texts ``data[offsets[j]:offsets[j + 1]]``; offsets start at 0.

    With ``terms``, runs of letters, digits and characters beyond ASCII instead.
    """
    n = len(data)
    word = ~(_NO_TERM if terms else _IS_SEP)[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins, finishes = word.copy(), word.copy()
    if n:
        begins[1:] &= ~word[:-1] | edge[1:n]
        finishes[:-1] &= ~word[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    hashes = _hash_words(_LOWER[data] if lower else data, starts, ends)
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets), hashes)


def slices(texts: pa.Array | pa.ChunkedArray, lower: bool = False, limit: int = SLICE_BYTES, terms: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first row, last row + 1, their words) of a text column, in slices of about ``limit`` bytes."""
    at = 0
    for chunk in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        chunk = chunk.fill_null("").cast(pa.large_string())
        _, offsets, data = chunk.buffers()
        n = len(chunk)
        if not n:
            continue
        offsets = np.frombuffer(offsets, np.int64)[chunk.offset : chunk.offset + n + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        low = 0
        while low < n:
            high = min(n, max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit))))
            yield at + low, at + high, of_bytes(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], lower, terms)
            low = high
        at += n


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` values, in order; runs may reach over the end of a text."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    count = len(hashes) - n + 1
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + count]
    return mix(out)


def inside(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, owners) of the windows of ``n`` words that lie in one text; first: see Words."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    before = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return np.arange(counts.sum()) - before[owner] + first[:-1][owner], owner


class Lookup:
    """Values by well-mixed 64-bit keys, each given once: a table with open addressing, filled and read by arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, (2 * len(keys)).bit_length())
        self.mask, self.at = size - 1, np.full(size, -1)
        self.keys, self.values = keys, values
        pending, slot = np.arange(len(keys)), (keys & np.uint64(self.mask)).astype(np.int64)
        while len(pending):
            free = self.at[slot] < 0
            self.at[slot[free]] = pending[free]
            left = self.at[slot] != pending
            pending, slot = pending[left], slot[left] + 1 & self.mask
        self.stored = np.where(self.at >= 0, keys[self.at], 0) if len(keys) else np.zeros(size, np.uint64)

    def get(self, keys: np.ndarray, missing: int = 0) -> np.ndarray:
        out = np.full(len(keys), missing, self.values.dtype)
        slot, asked, place = (keys & np.uint64(self.mask)).astype(np.int64), keys, None
        while len(slot):
            at = self.at[slot]
            hit = (self.stored[slot] == asked) & (at >= 0)
            out[np.flatnonzero(hit) if place is None else place[hit]] = self.values[at[hit]]
            go = np.flatnonzero(~hit & (at >= 0))
            place, slot, asked = (go if place is None else place[go]), slot[go] + 1 & self.mask, asked[go]
        return out


def hash_word(word: bytes) -> int:
    """The hash that ``of_bytes`` gives this word."""
    return int(of_bytes(np.frombuffer(word, np.uint8), np.array([0, len(word)])).hashes[0])
