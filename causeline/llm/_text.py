"""Vectorised words: one pass of array operations over the UTF-8 bytes of many texts.

A word's 64-bit hash is a polynomial over per-byte random constants, read off a running sum, so no
Python object is made for a word. Byte tables decide which bytes are in a word and fold A-Z.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from ._spark import raw

_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240131)
_BYTE = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: np.ndarray = np.ones(1, np.uint64)
_inverse: np.ndarray = np.ones(1, np.uint64)


def _fold(table: np.ndarray) -> np.ndarray:
    for c in range(ord("A"), ord("Z") + 1):
        if table[c]:
            table[c] = c + 32
    return table


def alnum_table() -> np.ndarray:
    """Words of 0-9, a-z and every code point from U+0080 on; A-Z folded. Other bytes map to 0."""
    t = np.zeros(256, np.uint8)
    t[128:] = np.arange(128, 256)
    for lo, hi in ((48, 57), (65, 90), (97, 122)):
        t[lo : hi + 1] = np.arange(lo, hi + 1)
    return _fold(t)


def blank_table() -> np.ndarray:
    """Words between ASCII white space (0x20, 0x09-0x0D); A-Z folded. NUL is kept apart as 255, which UTF-8 never has."""
    t = np.arange(256).astype(np.uint8)
    t[0] = 255
    t[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
    return _fold(t)


ALNUM, BLANK = alnum_table(), blank_table()


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) <= n:
        size = max(n + 1, 1 << 16)
        inv = pow(_BASE, -1, 1 << 64)
        _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, _BASE, np.uint64))])
        _inverse = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, inv, np.uint64))])


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of a slice of texts, in order. ``first[d]:first[d+1]`` are document d's."""

    start: np.ndarray  # byte offsets into ``data``
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    data: np.ndarray
    base: np.ndarray  # byte offset of each document in ``data``

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().lower().decode("utf-8", "replace")


def words(col: pa.Array, table: np.ndarray = ALNUM) -> Words:
    data, off = raw(col)
    lo, hi = int(off[0]), int(off[-1])
    data, off = data[lo:hi], off - lo
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(len(off), np.int64), np.zeros(0, np.uint64), data, off)
    low = table[data]
    inside = low != 0
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = off[(off > 0) & (off < n)]
    starts[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    _grow(n)
    run = np.empty(n + 1, np.uint64)
    run[0] = 0
    np.cumsum(_BYTE[low] * _powers[:n], out=run[1:])
    h = mix((run[e] - run[s]) * _inverse[s] + (e - s).astype(np.uint64))
    return Words(s, e, np.searchsorted(s, off), h, data, off)


def hash_word(word: str, table: np.ndarray = ALNUM) -> int:
    """Hash of one word, equal to the one ``words`` gives it."""
    w = words(pa.array([word]), table)
    return int(w.hash[0]) if len(w.hash) == 1 else 0
