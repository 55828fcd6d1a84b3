"""Words, word hashes and window hashes of whole texts, vectorised.

A word is a maximal run of bytes other than space and \\x09-\\x0D, i.e. the
pattern ``[^\\x20\\x09-\\x0D]+`` on the UTF-8 bytes.  A word's hash is a
polynomial of its bytes modulo 2**64, finished by an avalanche step, or xxh3
for a word of more than ``LONG`` bytes (such polynomials collide on crafted long
words, whatever the base); a window's hash is a polynomial of its word hashes,
finished likewise.  Two seeds give
128 bits where equality must be decided by hash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
LONG = 64
#: Odd multipliers, per seed: for bytes within words, for words within windows.
BASES = ((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept up to 16 M entries per base."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, U)
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= 1 << 24:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (a bijection)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _runs(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int) -> np.ndarray:
    """sum(values[j] * base**(j - lo)) for j in lo..hi-1, modulo 2**64."""
    n = len(values)
    sums = np.zeros(n + 1, U)
    np.cumsum(values * powers(base, n), out=sums[1:])
    inverse = pow(base, -1, 1 << 64)
    return (sums[hi] - sums[lo]) * powers(inverse, n + 1)[lo]


class Words:
    """The words of an array of texts (null: no words).

    ``start``/``end``: byte ranges in ``data``; ``first``: for each text the
    number of its first word, with one entry more at the end."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        whole = texts.buffers()[2]
        data = np.frombuffer(whole, np.uint8)[offsets[0]:offsets[-1]] if whole is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        begins = ~space
        ends = begins.copy()
        begins[1:] &= space[:-1]
        ends[:-1] &= space[1:]
        inner = offsets[1:-1]
        inner = inner[inner < len(data)]
        begins[inner] = ~space[inner]
        before = inner[inner > 0] - 1
        ends[before] = ~space[before]
        self.data, self.start = data, np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def split(self, whole: list[bytes] = ()) -> None:
        """Cut the words further wherever ASCII letters, an ASCII digit, and ASCII
        marks other than the apostrophe meet each other, and between digits.
        Words that hold one of ``whole`` (in either case) stay as they are."""
        data = self.data
        low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        kind = np.where((low >= 97) & (low <= 122), 1, np.where((data >= 48) & (data <= 57), 2, np.where(
            (data > 32) & (data < 127) & (data != 39), 3, 0))).astype(np.int8)
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (kind[1:] != 0) & (kind[:-1] != 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
        text = low.tobytes() if whole else b""
        for mark in whole:
            at = text.find(mark.lower())
            while at >= 0:
                word = np.searchsorted(self.start, at, "right") - 1
                cut[self.start[word]:max(self.end[word], at + len(mark))] = False
                at = text.find(mark.lower(), at + 1)
        begins, ends = cut.copy(), cut
        begins[self.start] = True
        ends[self.end] = True
        heads = np.append(self.start, len(data))[self.first]
        self.start, self.end = np.flatnonzero(begins[:-1]), np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, heads)

    def hashes(self, seed: int = 0) -> np.ndarray:
        base = BASES[seed][0]
        values = self.data.astype(U) + U(1)
        out = mix(_runs(values, self.start, self.end, base) + U(base) * (self.end - self.start).astype(U))
        for i in np.flatnonzero(self.end - self.start > LONG):
            out[i] = xxhash.xxh3_64_intdigest(self.data[self.start[i]:self.end[i]].tobytes(), seed=base)
        return out

    def windows(self, size: int, seed: int = 0, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(number of the first word, hash) of each window of ``size`` words
        that lies within one text, in order."""
        h = self.hashes(seed) if hashes is None else hashes
        left = np.repeat(self.first[1:], self.counts()) - np.arange(len(h))
        at = np.flatnonzero(left >= size)
        return at, mix(_runs(h, at, at + size, BASES[seed][1]) + U(size))

    def encoded(self) -> tuple[np.ndarray, list[bytes]]:
        """For each word its number in the list of distinct words, and that list."""
        size = self.end - self.start
        offsets = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=offsets[1:])
        take = np.arange(offsets[-1]) + np.repeat(self.start - offsets[:-1], size)
        packed = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[take])])
        coded = packed.dictionary_encode()
        return coded.indices.to_numpy(), coded.dictionary.to_pylist()

    def cut(self, text: bytes, kept: np.ndarray) -> bytes:
        """The text of the single document without the words that are not in
        ``kept`` and the white space after them."""
        gone = np.ones(len(self), bool)
        gone[kept] = False
        bounds = np.append(self.start, len(text))
        edge = np.zeros(len(text) + 1, np.int8)
        np.add.at(edge, bounds[:-1][gone], 1)
        np.add.at(edge, bounds[1:][gone], -1)
        return np.frombuffer(text, np.uint8)[np.cumsum(edge[:-1]) == 0].tobytes()

    def text(self, numbers: np.ndarray) -> bytes:
        """The words of these numbers, joined by one space."""
        if not len(numbers):
            return b""
        s, e = self.start[numbers], self.end[numbers]
        size = e - s + 1
        put = np.cumsum(size) - size
        out = np.full(int(size.sum()), 32, np.uint8)
        take = np.arange(len(out)) - np.repeat(put - s, size)
        inside = take < np.repeat(e, size)
        out[inside] = self.data[take[inside]]
        return out[:-1].tobytes()
