"""Vectorised word hashing over Arrow string buffers.

Texts are never turned into Python strings here: word boundaries, word hashes and
hashes of word runs are numpy operations over the bytes of a slice of a record
batch.  A slice holds about ``SLICE_BYTES`` of text (one document at least), which
bounds memory however many rows a batch has; within a longer text, bytes are looked at
in blocks of ``BLOCK_BYTES`` and what is kept is 16 bytes a word.

A word's hash takes its bytes eight at a time, each eight mixed before the next ones come in, so
that no algebra of the bytes survives (words of up to eight bytes and one length never
collide); long words go through BLAKE2b.  Runs of words are hashed the same way, in two lanes
of 64 bits where equal hashes are taken for equal words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_500_000
BLOCK_BYTES = 1 << 22
#: Longer words are hashed one by one.
LONG_WORD = 256
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

#: Word separators of the contracts: space and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters and digits; bytes of other scripts belong to words.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = True
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    NOT_ALNUM[ord(_a) : ord(_b) + 1] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


#: Odd constants of the two lanes.
LANES = ((U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)), (U64(0xC2B2AE3D27D4EB4F), U64(0xA0761D6478BD642F)))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)  # masks of the first n bytes of eight


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    size = (end - start).astype(np.int64)
    h = mix(size.astype(U64) * LANES[0][0])
    own = np.arange(len(size))
    at = 0
    while len(own):
        left = size[own] - at
        h[own] = mix(h[own] ^ (eight[start[own] + at] & _FIRST[np.minimum(left, 8)])) * LANES[0][1]
        at += 8
        own = own[left > 8]
        if at == 8:
            long = own[size[own] > LONG_WORD]
            if len(long):
                raw = buf.tobytes()
                for i in long.tolist():
                    h[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]], digest_size=8).digest(), "little")
                own = own[size[own] <= LONG_WORD]
    return h


_powers = {_BASE: np.ones(1, U64), _BASE_INV: np.ones(1, U64)}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers[base]
    while len(have) < n:
        have = np.concatenate([have, have * U64(pow(base, len(have), 1 << 64))])
        _powers[base] = have
    return have[:n]


def string_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    bufs = arr.buffers()
    if len(arr) == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batches, column: str = "text", budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about budget bytes of text, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, off = string_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(off, off[at] + budget, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


class Words:
    """Words of a slice: byte starts and ends, hashes, and per row the span of its words."""

    def __init__(self, arr: pa.Array, sep: np.ndarray = SPACE, lower: bool = False):
        self.buf, self.off = buf, off = string_bytes(arr)
        starts, ends, hashes = [], [], []
        open_ = -1  # where the word began that the last block broke off in
        for a in range(0, len(buf), BLOCK_BYTES):
            b = min(a + BLOCK_BYTES, len(buf))
            word = ~sep[buf[a:b]]
            before, after = np.empty(b - a, bool), np.empty(b - a, bool)
            before[1:], before[0] = word[:-1], open_ >= 0
            after[:-1], after[-1] = word[1:], b < len(buf) and not sep[buf[b]]
            cut = off[np.searchsorted(off, a) : np.searchsorted(off, b, "right")] - a  # rows begin here
            before[cut[cut < b - a]] = False
            after[cut[cut > 0] - 1] = False
            start, end = np.flatnonzero(word & ~before) + a, np.flatnonzero(word & ~after) + a + 1
            if open_ >= 0:
                start = np.concatenate([[open_], start])
            open_ = -1
            if len(start) > len(end):
                open_, start = int(start[-1]), start[:-1]
            if len(start):
                low = int(start[0])
                part = buf[low:b]
                hashes.append(span_hashes(_LOWER[part] if lower else part, start - low, end - low))
                starts.append(start.astype(np.int32))
                ends.append(end.astype(np.int32))
        self.start, self.end = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (starts, ends))
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        self.row = np.searchsorted(self.start, off)  # words of row r: row[r] to row[r + 1]
        self._lower = lower

    def prefixes(self, size: int) -> np.ndarray:
        """Hashes of the first size bytes (eight at most) of the words; 0 for shorter words."""
        eight = np.ndarray((len(self.buf) + 1,), "<u8", np.concatenate([_LOWER[self.buf] if self._lower else self.buf, np.zeros(8, np.uint8)]), strides=(1,))
        return np.where(self.end - self.start >= size, mix((eight[self.start] & _FIRST[size]) + LANES[1][0] * U64(size)), U64(0))

    def counts(self) -> np.ndarray:
        return np.diff(self.row)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start indexes of all runs of k words of one row, and their hashes."""
        at = gram_starts(self.row, k)
        return at, Runs(self.hash).of(at, k)


class Runs:
    """Hashes of runs of words.  Runs of 1, 2, 4, .. words are hashed from their halves; any run from the
    two such runs, perhaps overlapping, that it begins and ends with, and its length."""

    def __init__(self, h: np.ndarray, lane: int = 0):
        self.a, self.b = LANES[lane]
        self.levels = [mix(h * self.a)]

    def _join(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return mix(x * self.a + mix(y ^ self.b))

    def _level(self, p: int) -> np.ndarray:
        while len(self.levels) <= p:
            half = 1 << (len(self.levels) - 1)
            x = self.levels[-1]
            self.levels.append(self._join(x[:-half], x[half:]))
        return self.levels[p]

    def of(self, start: np.ndarray, length) -> np.ndarray:
        """Hashes of the runs of length words (a number, or one for each run) from start."""
        if np.ndim(length) == 0:
            p = int(length).bit_length() - 1
            if not len(start):
                return np.zeros(0, U64)
            x = self._level(p)
            return mix(self._join(x[start], x[start + length - (1 << p)]) + U64(int(self.b) * int(length) & (1 << 64) - 1))
        out = np.zeros(len(start), U64)
        for n in np.unique(length).tolist():
            own = np.flatnonzero(length == n)
            out[own] = self.of(start[own], n)
        return out


def gram_starts(row: np.ndarray, k: int) -> np.ndarray:
    """Where runs of k words of one row begin."""
    n = int(row[-1]) if len(row) else 0
    last = np.repeat(row[1:], np.diff(row))  # end of the element's row
    return np.flatnonzero(np.arange(n) + k <= last)


def row_of(bounds: np.ndarray) -> np.ndarray:
    """For each element the number of its row, from the rows' bounds."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def rolling(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin: polynomial hashes of runs of k words of one row, from running sums.  For short runs."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    last = np.repeat(row[1:], np.diff(row))  # end of the element's row
    at = np.flatnonzero(np.arange(n) + k <= last)
    total = np.zeros(n + 1, U64)
    np.cumsum(h * _power(_BASE, n), out=total[1:])
    g = (total[at + k] - total[at]) * _power(_BASE_INV, n)[at]
    return at, mix(g)
