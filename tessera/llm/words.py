"""Words and word sequences of Arrow text columns as numpy arrays.

A word is a maximal run of bytes other than space and ``\\x09``-``\\x0D`` of
the UTF-8 text (the pattern ``[^\\x20\\x09-\\x0D]+``).  Texts are handled in
blocks of bounded size, so that memory follows the block and not the column;
a text longer than a block is a block of its own, hashed in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_PIECE = 1 << 18
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finaliser)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _stream(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


_BYTE = _stream(256, 1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
PLAIN = _SPACE.copy()  # white space, full stops and commas
PLAIN[[44, 46]] = True
_STEP = _stream(64, 2) | _U(1)
_BASE = _U(0xD6E8FEB86659FD93)
_powers = np.ones(1, dtype=_U)


def _power(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        size = max(n, 1024, 2 * len(_powers))
        with np.errstate(over="ignore"):
            _powers = np.concatenate(([_U(1)], np.cumprod(np.full(size - 1, _BASE, dtype=_U))))
    return _powers


@dataclass
class Block:
    """Words of the rows ``first`` up to ``first + len(bounds) - 1`` of a batch.

    ``bounds[i]:bounds[i + 1]`` are the words of row ``first + i``; ``start``
    and ``end`` are byte positions in ``data``; ``hashes`` are 64-bit hashes.
    """

    first: int
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    data: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.bounds))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _hash_span(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words [start, end) of raw; words are in order and apart."""
    out = np.empty(len(start), dtype=_U)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(start, start[at] + _PIECE)))
        s, e = start[at:to], end[at:to]
        size = e - s
        lo = int(s[0])
        within = np.arange(int(size.sum()), dtype=np.int64)
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        place = within - np.repeat(first, size)
        letter = _BYTE[raw[lo : int(e[-1])][place + np.repeat(s - lo, size)]]
        letter *= _power(int(size.max()))[place]
        out[at:to] = np.add.reduceat(letter, first)
        out[at:to] += size.astype(_U) * _U(0x9E3779B97F4A7C15)
        at = to
    return mix(out)


def blocks(column: pa.Array, fold: bool = False, block_bytes: int = BLOCK_BYTES, apart: np.ndarray = _SPACE) -> Iterator[Block]:
    """Blocks of a text column; fold lower-cases A-Z before hashing, apart marks the bytes between words."""
    raw, offsets = text_bytes(column)
    n, row = len(offsets) - 1, 0
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + block_bytes, "right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[to])
        data = raw[lo:hi]
        if fold:
            data = _FOLD[data]
        inside = ~apart[data]
        begins = np.zeros(len(data) + 1, dtype=bool)
        begins[offsets[row : to + 1] - lo] = True  # a row's start ends the word before it
        starts = inside.copy()
        if len(data):
            starts[1:] &= ~inside[:-1] | begins[1:-1]
        start = np.flatnonzero(starts)
        ends = inside.copy()
        if len(data):
            ends[:-1] &= ~inside[1:] | begins[1:-1]
        end = np.flatnonzero(ends) + 1
        hashes = _hash_span(data, start, end) if len(start) else np.zeros(0, _U)
        bounds = np.searchsorted(start, offsets[row : to + 1] - lo)
        yield Block(row, bounds, start, end, hashes, data)
        row = to


def sequences(block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words that start at each word, and where all k are of one row."""
    n = len(block.hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, bool)
    out = np.zeros(n, dtype=_U)
    with np.errstate(over="ignore"):
        for j in range(k):
            out += block.hashes[j : j + n] * _STEP[j]
    ok = np.ones(n, dtype=bool)
    for b in np.unique(block.bounds[1:-1]):  # starts within k - 1 words before a bound cross it
        ok[max(0, b - k + 1) : b] = False
    return mix(out), ok


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of width values."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out
