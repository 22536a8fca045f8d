"""Words, hashes and windows of whole text columns, by numpy on Arrow buffers.

A column of texts is one buffer of UTF-8 bytes; words are runs of bytes of a class, and every hash is
taken from prefix sums of that buffer, so that no Python object is made for a word.
All arithmetic is modulo 2**64. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1

#: Bytes that fold to lower case: A-Z only.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

#: [^\x20\x09-\x0D]
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False

#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser (that of splitmix64), so that each bit of a sum spreads."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class _Powers:
    """base**i and its inverse for i below a size that grows when needed."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0
        self.up = self.down = np.empty(0, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = -(-n // (1 << 19)) * (1 << 19)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(self.n - 1, b, U)])) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_bytes, _words = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


def prefix(values: np.ndarray, powers: _Powers) -> np.ndarray:
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers.get(len(values))[0], out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    """The hash of each span [start, end), whatever its place."""
    return (sums[ends] - sums[starts]) * powers.get(len(sums))[1][starts]


@dataclass
class Words:
    """first[d]:first[d + 1] are the words of text d; starts and ends are places in buf."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        return mix(spans(prefix(self.buf.astype(U) + U(1), _bytes), self.starts, self.ends, _bytes) + (self.ends - self.starts).astype(U))

    def text(self, first: int, last: int) -> bytes:
        """The words first:last, joined by one space."""
        return b" ".join(self.buf[a:b].tobytes() for a, b in zip(self.starts[first:last], self.ends[first:last], strict=True))


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def words(column: pa.Array, kind: np.ndarray, fold: bool) -> Words:
    buf, off = buffer(column)
    if fold:
        buf = FOLD[buf]
    inside = kind[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begin)
    return Words(buf, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off), off)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive words; texts are not told apart."""
    n = max(0, len(hashes) - k + 1)
    at = np.arange(n)
    return mix(spans(prefix(hashes, _words), at, at + k, _words) + U(k))


def block_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of the words starts:ends, with their number."""
    return mix(spans(prefix(hashes ^ U(0x5851F42D4C957F2D), _words), starts, ends, _words) ^ mix((ends - starts).astype(U)))


def least(values: np.ndarray, width: int) -> np.ndarray:
    """For each width consecutive values, the place of the smallest; the last of equal ones."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    val, at, size = values, np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        right = val[step:] <= val[:-step]
        val, at = np.where(right, val[step:], val[:-step]), np.where(right, at[step:], at[:-step])
        size += step
    return at[:n]


def window_starts(w: Words, width: int) -> np.ndarray:
    """The words that start a window of width words of one text."""
    at = np.arange(len(w))
    return at[at + width <= np.repeat(w.first[1:], np.diff(w.first))]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has no more than limit bytes of text, but one row at least."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, side="right"))
            to = max(at + 1, to)
            yield batch.slice(at, to - at)
            at = to


def long_array(values: np.ndarray) -> pa.Array:
    """Unsigned hashes as signed longs."""
    return pa.array(values.view(np.int64) if values.dtype == U else values.astype(np.int64))
