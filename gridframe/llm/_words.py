"""Words of whole texts as arrays: where they start, and a 64-bit hash of each.

Works on the UTF-8 bytes of an Arrow string column, many texts at a time, so no
Python object is made for a word.  A word is a longest run of bytes of a class; both
classes used here hold every byte from 0x80, so no character is ever split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Everything but space and tab to carriage return.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Digits, letters a to z (after lower-casing) and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_powers = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        n = max(n, 2 * len(_powers))
        _powers = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _BASE)], dtype=np.uint64)
    return _powers


def hashed_words(texts: pa.Array, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts in a row, and where each text's begin.

    Gives ``hashes`` (uint64) and ``bounds`` (one more than there are texts); A-Z are
    lower-cased.  A null text has no words.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    low = _LOWER[raw]
    inside = kind[low]
    # A word starts where a byte of the class follows another one or begins a text.
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[firsts] |= inside[firsts]
    at = np.flatnonzero(starts)
    bounds = np.searchsorted(at, offsets)
    if not len(at):
        return np.zeros(0, np.uint64), bounds
    kept = np.flatnonzero(inside)
    first = np.searchsorted(kept, at)
    length = np.diff(np.r_[first, len(kept)])
    place = np.arange(len(kept)) - np.repeat(first, length)
    table = _power_table(int(length.max()))
    sums = np.add.reduceat((low[kept].astype(np.uint64) + np.uint64(1)) * table[place], first)
    return mix(sums + length.astype(np.uint64)), bounds


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows with about ``most`` bytes of ``column`` each."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // most
        edges = np.r_[0, np.flatnonzero(np.diff(group)) + 1, batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b > a:
                yield batch.slice(int(a), int(b - a))
