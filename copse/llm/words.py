"""Hashes of words and word windows, for many texts at once.

A word is a run of `[^\\x20\\x09-\\x0D]+`. A word's hash is the mixed sum of a value for each byte and its place in the word; a
window's is made of the hashes of its halves, mixed at every step; a whole text's is the mixed sum of a value for each word and its place. So no
arithmetic of the symbols alone makes two sequences equal, and equal word sequences have equal hashes wherever they stand. All functions
work on slices of at most `SLICE` bytes of whole texts (one longer text is a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE = 500_000
_PLACES = 64
_U = np.uint64
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _odd(seed: int) -> int:
    return int(mix(np.array([seed * 7919 + 1], dtype=_U))[0]) | 1


@lru_cache(maxsize=4)
def _near(seed: int) -> np.ndarray:
    """The values of every byte at each of the first `_PLACES` places."""
    return mix(np.arange(_PLACES << 8, dtype=_U) + _U(_odd(seed)))


def _values(data: np.ndarray, place: np.ndarray, seed: int) -> np.ndarray:
    code = place << 8 | data
    far = np.flatnonzero(code >= _PLACES << 8)
    if not len(far):
        return _near(seed)[code]
    out = _near(seed)[np.where(code < _PLACES << 8, code, 0)]
    out[far] = mix(code[far].astype(_U) + _U(_odd(seed)))
    return out


def places(sizes: np.ndarray) -> np.ndarray:
    """0 to size - 1 for each size in turn."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _joined(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    return mix(mix(a + _U(_odd(seed))) + b)


def runs_of(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """The hash of each k successive hashes, of those that begin at 0, 1, ...: halves are joined, so it takes about 2 log k steps."""
    out, size, power, span = None, 0, hashes, 1
    while len(hashes) >= k:
        if k & span:
            out = power if out is None else _joined(out[: max(0, len(hashes) - size - span + 1)], power[size:], seed + size)
            size += span
        if size == k:
            return out
        power = _joined(power[:-span], power[span:], seed + 1000 + span)
        span *= 2
    return np.zeros(0, dtype=_U)


class Words:
    """The words of a slice of texts. `first[i]:first[i+1]` are text i's words; `start`, `end` are byte offsets in `data`."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = ~_SEPARATOR[data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        cuts = offsets[(offsets > 0) & (offsets < len(data))]
        opens[cuts] = inside[cuts]
        self.start = np.flatnonzero(opens)
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        closes[cuts - 1] = inside[cuts - 1]
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)

    def hashes(self, seed: int = 0) -> np.ndarray:
        out = np.empty(len(self.start), dtype=_U)
        i = 0
        while i < len(out):  # a bounded stretch of a very long text at a time
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + SLICE, side="right")))
            data, sizes = self.data[self.start[i] : self.end[j - 1]], self.end[i:j] - self.start[i:j]
            if len(data) > SLICE:  # one very long word
                sums = np.zeros(1, dtype=_U)
                for lo in range(0, len(data), SLICE):
                    part = data[lo : lo + SLICE].astype(np.int64)
                    sums += _values(part, np.arange(lo, lo + len(part)), seed).sum(dtype=_U)
            else:
                data = data[~_SEPARATOR[data]].astype(np.int64)
                sums = np.add.reduceat(_values(data, places(sizes), seed), np.cumsum(sizes) - sizes)
            out[i:j] = mix(sums + sizes.astype(_U))
            i = j
        return out

    def windows(self, hashes: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """For each word, the hash of the k words from it on (any, where they do not lie within its text), and whether they do."""
        found = runs_of(hashes, k, seed)
        last = np.repeat(self.first[1:], self.counts)
        return np.append(found, np.zeros(len(hashes) - len(found), dtype=_U)), np.arange(len(hashes)) + k <= last

    def whole(self, hashes: np.ndarray, seed: int = 0) -> np.ndarray:
        out = np.zeros(len(self.counts), dtype=_U)
        some = np.flatnonzero(self.counts)
        if len(some):
            values = mix(hashes + mix(places(self.counts).astype(_U) + _U(_odd(seed + 211))))
            out[some] = np.add.reduceat(values, self.first[:-1][some])
        return mix(out + self.counts.astype(_U))


def slices(column: pa.Array, table: np.ndarray | None = None) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) over a string column, a bounded number of bytes at a time; null counts as empty.

    `table`: what each byte stands for, where words are of other bytes than usual.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, side="right")) - 1)
        to = min(to, len(column))
        own = data[offsets[row] : offsets[to]]
        yield row, to, Words(own if table is None else table[own], offsets[row : to + 1] - offsets[row])
        row = to
