"""Words of many texts at once, as numpy arrays over an Arrow column; used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes that separate words: space and \t \n \v \f \r.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about max_bytes of text each (one very long text still is one part)."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of a string column, nulls having none.

    offsets[i]:offsets[i+1] are the words of text i; joined holds all words, each followed by one
    space; word k is joined[starts[k]:ends[k]].
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        n = len(texts)
        where = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        data = texts.buffers()[2] if n else None
        raw = np.frombuffer(data, np.uint8)[where[0] : where[-1]] if data is not None else np.zeros(0, np.uint8)
        where = where - where[0]
        if lower:
            raw = _LOWER[raw]
        inside = ~_SPACE[raw]
        before = np.zeros(len(raw) + 1, bool)
        before[1:] = inside
        before[where[:-1]] = False  # a text starts anew
        begin = np.flatnonzero(inside & ~before[:-1])
        after = np.zeros(len(raw) + 1, bool)
        after[:-1] = inside
        after[where[1:]] = False
        lengths = np.flatnonzero(inside & ~after[1:]) + 1 - begin
        self.offsets = np.searchsorted(begin, where)
        #: First byte of every word in the column's bytes, and where each text begins and ends there.
        self.begin, self.where = begin, where
        self.count = len(begin)
        self._letters = raw[inside]
        order = np.arange(self.count)
        self._cut = np.zeros(self.count + 1, np.int64)
        np.cumsum(lengths, out=self._cut[1:])
        self.starts = self._cut[:-1] + order
        self.ends = self.starts + lengths
        out = np.full(len(self._letters) + self.count, 0x20, np.uint8)
        out[np.arange(len(self._letters)) + np.repeat(order, lengths)] = self._letters
        self.joined = out
        self._codes = None

    def lowered(self) -> Words:
        """The same words with A-Z in lower case."""
        out = copy(self)
        out._letters, out.joined, out._codes = _LOWER[self._letters], _LOWER[self.joined], None
        return out

    def encoded(self) -> tuple[np.ndarray, list[bytes]]:
        """(code of every word, the distinct words by code)."""
        if self._codes is None:
            words = pa.Array.from_buffers(pa.large_binary(), self.count, [None, pa.py_buffer(self._cut), pa.py_buffer(self._letters)])
            coded = words.dictionary_encode()
            self._codes = np.asarray(coded.indices), coded.dictionary.to_pylist()
        return self._codes

    def hashes(self, seed: int = 0) -> np.ndarray:
        """XXH64 of every word."""
        codes, distinct = self.encoded()
        h = xxhash.xxh64_intdigest
        return np.fromiter((h(w, seed) for w in distinct), np.uint64, len(distinct))[codes]

    def text_of(self) -> np.ndarray:
        """The number of its text for every word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum for each text of a value per word."""
        total = np.zeros(self.count + 1, np.int64)
        np.cumsum(values, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def full(self, width: int) -> np.ndarray:
        """Numbers of the words at which `width` words of one text start."""
        fits = np.zeros(self.count, bool)
        n = np.diff(self.offsets)
        left = np.repeat(self.offsets[1:], n) - np.arange(self.count)
        fits[:] = left >= width
        return np.flatnonzero(fits)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd, 3 modulo 8: powers differ by few factors of two, so exchanged words change the hash.
_BASE = 0x9E3779B97F4A7C13


def rolling(hashes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash modulo 2^64 of the `width` word hashes from each start, mixed."""
    out = np.zeros(len(starts), np.uint64)
    if len(starts):
        for j in range(width):
            out = out * np.uint64(_BASE) + hashes[starts + j]
    return mixed(out)
