"""Words, shingles and rolling hashes of many texts at once, on Arrow string buffers.

A word is a maximal run of bytes other than space and 0x09-0x0D. Hashes are 64-bit polynomial
(Rabin-Karp) hashes modulo 2**64 over randomised symbols, so the hash of any stretch follows from two
prefix sums. All functions work on groups of whole texts of a few megabytes; a longer text is a group
of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

GROUP_BYTES = 2 << 20
SLAB_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# everything in ASCII but letters and digits; other characters count as letters
IS_MARK = np.arange(256) < 128
IS_MARK[[c for c in range(128) if chr(c).isalnum()]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        known = np.ones(size, np.uint64)
        known[1:] = np.uint64(base)
        _powers[base] = known = np.multiply.accumulate(known)
    return known[:n]


class Rolling:
    """Prefix sums of a symbol array; ``of`` hashes any stretches of it."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * _power_table(_BASE, n), out=self.sums[1:])
        self.inverse = _power_table(_INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of ``symbols[start:end]``, without its length."""
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def windows(self, k: int) -> np.ndarray:
        """Mixed hash of every ``k`` consecutive symbols."""
        n = len(self.sums) - 1
        if n < k:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:-k]) * self.inverse[: n - k + 1])


class Group(NamedTuple):
    """Whole texts ``lo:hi`` of a batch: their bytes, and where each starts (one more at the end)."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


def groups(column: pa.Array, limit: int = GROUP_BYTES) -> Iterator[Group]:
    """Consecutive texts of an Arrow column, up to ``limit`` bytes at a time; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield Group(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


class Words(NamedTuple):
    """All words of a group: hash, byte range, and per text the index of its first word."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def owner(self) -> np.ndarray:
        """Text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _cuts(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Slab borders that cut no word: text borders, or white space inside a long text."""
    cuts, at, n = [0], 0, len(data)
    while at < n:
        to = int(offsets[np.searchsorted(offsets, at + SLAB_BYTES, "right") - 1])
        if to <= at:
            to = min(at + SLAB_BYTES, n)
            while to < n and not IS_SPACE[data[to]]:
                gap = np.flatnonzero(IS_SPACE[data[to : to + SLAB_BYTES]])
                to = to + int(gap[0]) if len(gap) else min(to + SLAB_BYTES, n)
        at = to
        cuts.append(at)
    return cuts


def words(group: Group, fold: bool = False, between: np.ndarray = IS_SPACE) -> Words:
    """Words of a group, split at the bytes marked in ``between``; ``fold`` hashes A-Z as a-z."""
    data, offsets = group.data, group.offsets
    hashes, starts, ends = [], [], []
    cuts = _cuts(data, offsets)
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        part = data[lo:hi]
        solid = ~between[part]
        edge = np.zeros(hi - lo + 1, bool)
        inside = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, "right")]
        edge[inside - lo] = True
        before = np.concatenate(([False], solid[:-1]))
        after = np.concatenate((solid[1:], [False]))
        start = np.flatnonzero(solid & (~before | edge[:-1]))
        end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        rolling = Rolling(BYTE_SYMBOL[LOWER[part] if fold else part])
        hashes.append(mix(rolling.of(start, end) + (end - start).astype(np.uint64)))
        starts.append(start + lo)
        ends.append(end + lo)
    if not hashes:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64))
    start = np.concatenate(starts)
    return Words(np.concatenate(hashes), start, np.concatenate(ends), np.searchsorted(start, offsets))


def spans_inside(first: np.ndarray, width: int) -> np.ndarray:
    """Starts of all windows of ``width`` symbols that stay inside one text."""
    n = int(first[-1])
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, first[:-1], 1)
    np.add.at(marks, np.maximum(first[:-1], first[1:] - width + 1), -1)
    return np.flatnonzero(np.cumsum(marks[:-1]) > 0)


def shingles(found: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width``-word shingles and the text of each, in text order.

    A text with fewer words, but at least one, has a single shingle of all its words.
    """
    counts = np.diff(found.first)
    rolling = Rolling(found.hash)
    at = spans_inside(found.first, width)
    full = mix(rolling.of(at, at + width))
    texts = np.repeat(np.arange(len(counts)), np.maximum(counts - width + 1, 0))
    short = np.flatnonzero((counts > 0) & (counts < width))
    if not len(short):
        return full, texts
    own = mix(rolling.of(found.first[short], found.first[short + 1]))
    texts = np.concatenate((texts, short))
    order = np.argsort(texts, kind="stable")
    return np.concatenate((full, own))[order], texts[order]


def distinct_per_text(values: np.ndarray, texts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, end to end, and the border of each text."""
    order = np.lexsort((values, texts))
    values, texts = values[order], texts[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (texts[1:] != texts[:-1])
    values, texts = values[fresh], texts[fresh]
    return values, np.searchsorted(texts, np.arange(n + 1))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
