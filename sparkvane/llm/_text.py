"""Vectorised words, hashes and shingles over Arrow string buffers.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. All separators are
single ASCII bytes, so words can be cut on UTF-8 bytes. Hashes are 64-bit: a
random-table polynomial over bytes, then a bijective mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that one vectorised step takes: its arrays are some 100 times as large in bytes at most.
CHUNK = 1 << 18
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Letters, digits, apostrophes and all bytes of longer characters.
IS_ALNUM = np.zeros(256, bool)
IS_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), 39, *range(128, 256)]] = True
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_BASE = U64(0x9E3779B97F4A7C15 | 3)
_INV = U64(pow(int(_BASE), -1, 2**64))
_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, b in enumerate((_BASE, _INV)):
            p = np.full(size, b, U64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    out = _powers[0][:n], _powers[1][:n]
    if n > 2 * CHUNK:  # one huge text: do not keep its tables
        _powers[0], _powers[1] = _powers[0][:CHUNK].copy(), _powers[1][:CHUNK].copy()
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits with full avalanche (in place)."""
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def utf8(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1] if offsets else np.zeros(len(col) + 1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return buf, offs


def pieces(offs: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one longer text."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words:
    """The words of rows i..j: byte spans, row boundaries, hashes."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, lower: bool = False, table: np.ndarray = IS_WORD):
        self.b = b = buf[offs[0] : offs[-1]]
        o = offs - offs[0]
        is_word = table[b]
        first = is_word.copy()
        last = is_word.copy()
        if len(b):
            first[1:] &= ~is_word[:-1]
            last[:-1] &= ~is_word[1:]
            full = o[:-1] < o[1:]
            x, y = o[:-1][full], o[1:][full] - 1
            first[x] = is_word[x]
            last[y] = is_word[y]
        self.s = np.flatnonzero(first)
        self.e = np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.s, o)  # row r has words at[r]..at[r+1]
        self.n = np.diff(self.at)
        self.lower = lower
        self._h = None

    @property
    def h(self) -> np.ndarray:
        if self._h is None:
            p, q = powers(len(self.b) + 1)
            c = np.zeros(len(self.b) + 1, U64)
            np.cumsum((_LOWER if self.lower else _TABLE)[self.b] * p[:-1], out=c[1:])
            self._h = mix((c[self.e] - c[self.s]) * q[self.s])
        return self._h

    def rolling(self):
        """A function of word index arrays (a, z) to the hash of words a..z."""
        p, q = powers(len(self.s) + 1)
        c = np.zeros(len(self.s) + 1, U64)
        np.cumsum(self.h * p[:-1], out=c[1:])
        return lambda a, z: mix((c[z] - c[a]) * q[a] + (z - a).astype(U64) * U64(0xD6E8FEB86659FD93))

    def grams(self, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word shingles, row by row, and the rows' offsets in
        them; with `short`, a row of 1..k-1 words has its whole sequence."""
        cnt = np.maximum(self.n - k + 1, 0)
        if short:
            cnt = np.where((self.n > 0) & (self.n < k), 1, cnt)
        at = np.zeros(len(cnt) + 1, np.int64)
        np.cumsum(cnt, out=at[1:])
        a = np.arange(at[-1]) + np.repeat(self.at[:-1] - at[:-1], cnt)
        z = np.minimum(a + k, np.repeat(self.at[1:], cnt))
        return self.rolling()(a, z), at


def unique_by_row(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row in ascending order, and the rows' offsets."""
    h = h.copy()
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        h[i:j].sort()
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[keep], row[keep]
    return h, np.searchsorted(row, np.arange(len(at)))


def list_array(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column over a flat array."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, kind))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
