"""Words of whole texts as arrays of hashes, for functions that run on Arrow batches.

A word is a run of bytes other than 0x20 and 0x09 to 0x0D, as in the pattern
``[^\\x20\\x09-\\x0D]+``.  Hashes of all words of a stretch of text come from one
pass: prefix sums of byte values times powers of an odd number, modulo 2**64,
whose differences are the words' polynomial hashes; a mixing step follows.
Equal words have equal hashes; two different words share one with a chance of
about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text is worked on in stretches of about so many bytes.  A longer text is cut
#: between words for hashing only; its words come together again.
STRETCH = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, kept for the next call."""
    if len(_powers[0]) < n:
        size = max(n, STRETCH + 4096)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """Words of ``len(first) - 1`` texts, one after the other.

    ``first[i]:first[i + 1]`` are the words of text ``i``; ``start`` and ``end``
    are places in ``raw``, the bytes of all texts.
    """

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    raw: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _spans(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; no word crosses one of the ``edges``."""
    space = SPACE[raw]
    before, after = np.empty(len(raw), bool), np.empty(len(raw), bool)
    before[0], before[1:] = True, space[:-1]
    after[-1], after[:-1] = True, space[1:]
    inner = edges[(edges > 0) & (edges < len(raw))]
    before[inner] = True
    after[inner - 1] = True
    word = ~space
    return np.flatnonzero(word & before), np.flatnonzero(word & after) + 1


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` for each span; values are 64-bit numbers per place."""
    power, inverse = powers(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power, out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * _BASE)


def _hashed(raw: np.ndarray, edges: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(raw):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    start, end = _spans(raw, edges)
    return span_hashes(_BYTE[LOWER[raw] if fold else raw], start, end), start, end


def words_of(raw: np.ndarray, offsets: np.ndarray, fold: bool = True) -> Words:
    """Words of the texts ``raw[offsets[i]:offsets[i + 1]]``; ``fold`` lower-cases A to Z."""
    offsets = offsets.astype(np.int64)
    parts, at = [], int(offsets[0])
    while at < offsets[-1]:
        to = min(at + STRETCH, int(offsets[-1]))
        while to < offsets[-1]:  # cut at a text's edge or at a space
            edge = int(offsets[np.searchsorted(offsets, to, "right") - 1])
            spaces = np.flatnonzero(SPACE[raw[max(at, to - 4096):to]]) if edge <= at else []
            if edge > at or len(spaces):
                to = edge if edge > at else max(at, to - 4096) + int(spaces[-1]) + 1
                break
            to = min(to + STRETCH, int(offsets[-1]))
        lo, hi = np.searchsorted(offsets, (at, to))
        hashes, start, end = _hashed(raw[at:to], offsets[lo:hi + 1] - at, fold)
        parts.append((hashes, start + at, end + at))
        at = to
    if not parts:
        parts = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))]
    hashes, start, end = (np.concatenate(x) for x in zip(*parts))
    first = np.searchsorted(start, offsets)
    return Words(hashes, start, end, first, raw)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def stretches(column: pa.Array, fold: bool = True) -> Iterator[tuple[int, int, Words]]:
    """Rows ``lo:hi`` of a string column and their words, about :data:`STRETCH` bytes at a time."""
    raw, offsets = text_bytes(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + STRETCH, "right")) - 1)
        yield lo, hi, words_of(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], fold)
        lo = hi


def n_grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside one text, and the place of each run's first word."""
    total = len(words.hash) - n + 1
    if total <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    sums = words.hash[:total] * np.uint64(3)
    for k in range(1, n):
        sums = mix(sums) + words.hash[k:k + total] * np.uint64(2 * k + 3)
    owner = words.owner()
    inside = np.flatnonzero(owner[:total] == owner[n - 1:])
    return mix(sums[inside] + np.uint64(n)), inside


def ranges(words: Words) -> Iterator[tuple[int, int]]:
    """Ranges of words that lie within about :data:`STRETCH` bytes, in order."""
    lo, n = 0, len(words.start)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(words.end, words.start[lo] + STRETCH, "right")))
        yield lo, hi
        lo = hi


_KIND = np.arange(256, dtype=np.uint8)
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = ord("0"), ord("A"), ord("a"), 128


def shapes(words: Words) -> np.ndarray:
    """Hash of each word's shape: runs of capitals, small letters, digits, other letters and of one sign."""
    out = np.empty(len(words.hash), np.uint64)
    for lo, hi in ranges(words):
        at = words.start[lo]
        kind = _KIND[words.raw[at:words.end[hi - 1]]]
        start, end = words.start[lo:hi] - at, words.end[lo:hi] - at
        new = np.ones(len(kind), bool)
        new[1:] = kind[1:] != kind[:-1]
        new[start] = True
        kept = np.flatnonzero(new)
        out[lo:hi] = span_hashes(_BYTE[kind[kept]], np.searchsorted(kept, start), np.searchsorted(kept, end))
    return out
