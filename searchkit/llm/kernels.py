"""Vectorised text kernels shared by the operators that run inside Arrow batches.

Texts stay in the flat UTF-8 buffer that Arrow hands over; words are found with
byte tables and hashed with prefix sums, so the cost is a few numpy passes a
byte and memory is bounded by the slice size, not by the batch or the document.
A null text is an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one slice of documents holds (a longer document is a slice of its own).
SLICE_BYTES = 2 << 20
#: Words longer than this are hashed one by one, by BLAKE2: unlike words of equal sums, which a sum of powers modulo 2^64
#: has for any base, are known from about 1,000 bytes on.
LONG_WORD = 512

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), in place on a fresh array."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _table() -> np.ndarray:
    return _mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


_BYTE = _table()
_BASE = 0x2545F4914F6CDD1D
_POW: dict[int, np.ndarray] = {}
_INV = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below n (kept, and grown on demand)."""
    have = _POW.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << max(0, n - 1).bit_length())
        have = np.full(size, _U(base & 0xFFFFFFFFFFFFFFFF))
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POW[base] = have
    return have[:n]


def space_words() -> np.ndarray:
    """Byte table of words `[^\\x20\\x09-\\x0D]+`."""
    t = np.ones(256, dtype=bool)
    t[[0x20, *range(0x09, 0x0E)]] = False
    return t


def alnum_words() -> np.ndarray:
    """Byte table of words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` (of lower-cased text)."""
    t = np.zeros(256, dtype=bool)
    t[0x30:0x3A] = True
    t[0x61:0x7B] = True
    t[0x80:] = True
    return t


SPACE_WORDS, ALNUM_WORDS = space_words(), alnum_words()

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows (one more than rows)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, off, data = col.buffers()
    off = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) of at most `limit` bytes, or of one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


class Words:
    """The words of some documents: byte bounds, hashes, and each document's first word."""

    __slots__ = ("data", "starts", "ends", "first", "_hash")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACE_WORDS):
        n = len(data)
        self.data, self._hash = data, None
        inside = table[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edges = offsets[:-1][offsets[:-1] < n]
        begins[edges] = inside[edges]
        self.starts = np.flatnonzero(begins)
        ends = inside
        after = ends.copy()
        after[:-1] &= ~ends[1:]
        last = offsets[1:][offsets[1:] > 0] - 1
        after[last] = ends[last]
        self.ends = np.flatnonzero(after) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def hashes(self) -> np.ndarray:
        if self._hash is None:
            self._hash = word_hashes(self.data, self.starts, self.ends)
        return self._hash


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; equal bytes have equal hashes in every process."""
    out = np.empty(len(starts), np.uint64)
    long = np.flatnonzero(ends - starts > LONG_WORD)
    i, n = 0, len(starts)
    cuts = [*long.tolist(), n]
    for stop in cuts:
        while i < stop:
            j = min(max(int(np.searchsorted(ends, starts[i] + (1 << 19), side="right")), i + 1), stop)
            lo, hi = int(starts[i]), int(ends[j - 1])
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(_BYTE[data[lo:hi]] * _powers(_BASE, hi - lo), out=total[1:])
            s, e = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = _mix((total[e] - total[s]) * _powers(_INV, hi - lo)[s] + (e - s).astype(np.uint64))
            i = j
        if i < n:
            digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
            out[i] = int.from_bytes(digest, "little")
            i += 1
    return out


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words, by its first word; the last k - 1 words begin none."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    out = np.empty(n - k + 1, np.uint64)
    step = 1 << 18
    for a in range(0, len(out), step):
        b = min(a + step, len(out))
        total = np.zeros(b - a + k, np.uint64)
        np.cumsum(hashes[a : b + k - 1] * _powers(_BASE, b - a + k - 1), out=total[1:])
        out[a:b] = _mix((total[k:] - total[: b - a]) * _powers(_INV, b - a) + _U(k))
    return out


def whole(first: np.ndarray, n_words: int, k: int) -> np.ndarray:
    """Whether the run of k words from each word stays in its document (for `gram_hashes` rows)."""
    out = np.ones(max(0, n_words - k + 1), bool)
    if k > 1 and len(out):
        bounds = np.unique(first[(first > 0) & (first < n_words)])
        marks = np.zeros(n_words + 1, np.int32)
        np.add.at(marks, np.maximum(bounds - (k - 1), 0), 1)
        np.add.at(marks, bounds, -1)
        out &= np.cumsum(marks)[: len(out)] == 0
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive values."""
    n = len(x)
    if n < w:
        return x[:0]
    pad = -n % w
    full = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(full, axis=1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])
