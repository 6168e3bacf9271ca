"""Words of whole Arrow text columns as numpy arrays, without a Python loop per word.

A word is a run of bytes other than space and tab to carriage return.  Texts are
walked in pieces of bounded size, cut only between words, so a text of any length
needs the memory of one piece (a single longer word is one piece of its own).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are turned into arrays at once.
PIECE = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

#: Lower-cases, and makes every ASCII byte but letters and digits a space.
PLAIN = _LOWER.copy()
PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 0x20

#: Odd multipliers of the two word hashes, and of their finishing step.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i < n."""
    up = np.full(n, base, np.uint64)
    down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_TABLES: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}


def _tables(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    usual = PIECE + 64
    size = max(usual, n)
    if size not in _TABLES:
        if size > usual:  # an unusually long word: do not keep its tables
            return [_powers(b, size) for b in _BASES]
        _TABLES[size] = [_powers(b, size) for b in _BASES]
    return _TABLES[size]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


@dataclass
class Words:
    """Words of some texts: ``data`` are the bytes, ``doc`` is the text's place in the
    column, ``start`` and ``end`` are places in ``data``."""

    data: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.data)
        out = np.zeros(len(self.start), np.uint64)
        if not len(out):
            return out
        for (up, down), shift in zip(_tables(n + 1), (0, 31), strict=True):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
            value = (sums[self.end] - sums[self.start]) * down[self.start]
            out = mix(out + (value << np.uint64(shift) | value >> np.uint64((64 - shift) % 64)))
        return out


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, raw: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Cut the bytes into ranges of about ``size``, never inside a word."""
    at, n = 0, len(raw)
    while at < n:
        to = at + size
        if to >= n:
            to = n
        else:
            k = np.searchsorted(offsets, to, "right") - 1
            if offsets[k] > at:
                to = int(offsets[k])  # between two texts
            else:  # inside a long text: back to its last space, else on to the next
                spaces = np.flatnonzero(_SPACE[raw[at:to]])
                if len(spaces):
                    to = at + int(spaces[-1]) + 1
                else:
                    limit = int(offsets[k + 1])
                    while to < limit and not _SPACE[raw[to]]:
                        to += 1
        yield at, to
        at = to


def words(column: pa.Array, table: np.ndarray = _LOWER, size: int = PIECE) -> Iterator[Words]:
    """The words of a string column, piece by piece, in order, after replacing bytes."""
    raw, offsets = column_bytes(column)
    for a, b in pieces(offsets, raw, size):
        data = table[raw[a:b]]
        inside = ~_SPACE[data]
        # Texts follow each other without a space: their starts cut words too.
        cuts = offsets[np.searchsorted(offsets, a, "left") : np.searchsorted(offsets, b, "left")] - a
        cuts = cuts[(cuts >= 0) & (cuts < b - a)]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[cuts] = inside[cuts]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        late = cuts[cuts > 0] - 1
        ends[late] = inside[late]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        yield Words(data, np.searchsorted(offsets, start + a, "right") - 1, start, end)


def trim() -> None:
    """Give memory of freed arrays back to the system, where its allocator can."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release is not None:
        release(0)
