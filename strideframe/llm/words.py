"""Hashes of words and word windows for whole Arrow batches, as numpy operations on the UTF-8 bytes.

A word hash is a polynomial over the bytes modulo 2**64 with a random value per byte, finished by a 64-bit mixer;
a window hash is a polynomial over word hashes, finished the same way. Prefix sums give every hash of a buffer in a
few vector operations. Long buffers are cut between words, so memory follows ``_PIECE``, not the text.
"""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
_PIECE = 1 << 20
_BYTE_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xC2B2AE3D27D4EB4F | 1
_LENGTH = U64(0xD6E8FEB86659FD93)
_SLAB = 4 << 20

#: Bytes of words between ASCII white space (0x20, 0x09-0x0D).
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words of letters and digits: 0-9, a-z, A-Z and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    ALNUM[_lo:_hi] = True
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SAME = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << int(n - 1).bit_length()
            up, down = np.full(size, U64(self.base)), np.full(size, U64(self.inverse))
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
        return self.up[:n], self.down[:n]


@lru_cache(maxsize=None)
def _powers(base: int) -> _Powers:
    return _Powers(base)


def slabs(column: pa.Array, limit: int = _SLAB) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows and the end) in slabs of about ``limit`` bytes; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1] or b"\0" * 8, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class WordSlab:
    """Words of the documents of a slab: byte bounds, hashes, and per document the range of its words."""

    def __init__(
        self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: np.ndarray, cuts: np.ndarray | None = None
    ):
        """``cuts``: further places, ascending, where one word ends and another begins."""
        self.data, self.lower = data, lower
        values = _BYTE_VALUES[lower]
        starts, ends, hashes = [], [], []
        cut = 0
        bounds = offsets[:-1][offsets[:-1] < offsets[1:]]
        if cuts is not None:
            bounds = np.union1d(bounds, cuts)
        word = inside[data]
        while cut < len(data):
            stop = min(cut + _PIECE, len(data))
            if stop < len(data):
                stop = self._between(word, bounds, cut, stop)
            s, e = self._runs(word, bounds, cut, stop)
            up, down = _powers(_BYTE_BASE).upto(stop - cut)
            sums = np.zeros(stop - cut + 1, U64)
            np.cumsum(values[data[cut:stop]] * up, out=sums[1:])
            h = (sums[e] - sums[s]) * down[s] + (e - s).astype(U64) * _LENGTH
            starts.append(s + cut)
            ends.append(e + cut)
            hashes.append(mix(h))
            cut = stop
        none = np.zeros(0, np.int64)
        self.starts = np.concatenate(starts) if starts else none
        self.ends = np.concatenate(ends) if ends else none
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        self.first = np.searchsorted(self.starts, offsets)  # of each document, and the end

    @staticmethod
    def _between(word: np.ndarray, bounds: np.ndarray, cut: int, stop: int) -> int:
        """A place near ``stop`` that no word crosses."""
        gap = np.flatnonzero(~word[cut + 1 : stop + 1])
        at = int(gap[-1]) + cut + 1 if len(gap) else cut
        i = int(np.searchsorted(bounds, stop, "right")) - 1
        at = max(at, int(bounds[i]) if i >= 0 else 0)
        if at > cut:
            return at
        gap = np.flatnonzero(~word[stop:])  # one word longer than a piece
        at = int(gap[0]) + stop if len(gap) else len(word)
        return min(at, int(bounds[i + 1])) if i + 1 < len(bounds) else at

    @staticmethod
    def _runs(word: np.ndarray, bounds: np.ndarray, cut: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        w = word[cut:stop]
        breaks = bounds[np.searchsorted(bounds, cut) : np.searchsorted(bounds, stop)] - cut
        joined = np.zeros(len(w) + 1, bool)
        joined[1:-1] = w[1:] & w[:-1]
        joined[breaks] = False
        return np.flatnonzero(w & ~joined[:-1]), np.flatnonzero(w & ~joined[1:]) + 1

    def docs(self) -> int:
        return len(self.first) - 1

    def words(self, lo: int, hi: int) -> list[bytes]:
        raw = self.lower[self.data[self.starts[lo] : self.ends[hi - 1]]].tobytes() if hi > lo else b""
        base = int(self.starts[lo]) if hi > lo else 0
        return [raw[s - base : e - base] for s, e in zip(self.starts[lo:hi].tolist(), self.ends[lo:hi].tolist())]

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(start word, hash) of every window of ``size`` words that lies in one document."""
        owner = np.repeat(np.arange(self.docs()), np.diff(self.first))
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        at = np.flatnonzero(owner[: n] == owner[size - 1 :])
        return at, window_hashes(self.hashes, size)[at]


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words) - size + 1
    out = np.zeros(max(n, 0), U64)
    salt = U64(size * int(_LENGTH) % (1 << 64))
    for lo in range(0, max(n, 0), _PIECE):
        part = words[lo : min(lo + _PIECE, n) + size - 1]
        up, down = _powers(_WORD_BASE).upto(len(part))
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(part * up, out=sums[1:])
        m = len(part) - size + 1
        out[lo : lo + m] = mix((sums[size:] - sums[:m]) * down[:m] + salt)
    return out
