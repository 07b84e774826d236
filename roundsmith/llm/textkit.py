"""Vectorised word, shingle and hash kernels over Arrow string columns.

Everything works on the concatenated UTF-8 bytes of many documents at once, so the cost for each
document is a few numpy calls and never one Python call for each word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

pa.set_memory_pool(pa.system_memory_pool())  # so that trim() can give its memory back
U64 = np.uint64
#: White space of the word contracts: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_RNG = np.random.default_rng(20240229)
RAW = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
#: As RAW, with A-Z hashed as a-z.
FOLDED = RAW.copy()
FOLDED[65:91] = RAW[97:123]
_P = U64(0x9E3779B97F4A7C15 | 1)
_P_INV = U64(pow(0x9E3779B97F4A7C15 | 1, -1, 2**64))
_MULT = _RNG.integers(1, 2**63, 64, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_powers = [np.ones(1, U64), np.ones(1, U64)]
SLICE_BYTES = 1 << 19


def trim() -> None:
    """Gives freed memory back to the system: workers are kept for the next task."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i for i < n, modulo 2^64."""
    if len(_powers[0]) < n:
        for k, p in enumerate((_P, _P_INV)):
            a = np.full(max(n, SLICE_BYTES + 1), p, U64)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=U64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur3's)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if offsets and len(col) else np.zeros(len(col) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def pieces(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of slices of a string column."""
    data, offs = buffers(col)
    for i, j in slices(offs, limit):
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words of each row: maximal runs without space."""
    n = len(data)
    solid = ~space[data]
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    start[edge] = solid[edge]
    end[edge - 1] = solid[edge - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def prefix_hash(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """s with s[j] - s[i] = P^i times the polynomial hash of bytes i to j."""
    s = np.zeros(len(data) + 1, U64)
    np.cumsum(table[data] * powers(len(data) + 1)[0][: len(data)], dtype=U64, out=s[1:])
    return s


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes have equal hashes."""
    inv = powers(len(prefix))[1]
    return mix((prefix[ends] - prefix[starts]) * inv[starts] + (ends - starts).astype(U64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = FOLDED, space: np.ndarray = SPACE):
    """Starts, ends, rows and hashes of words."""
    starts, ends, rows = words(data, offsets, space)
    return starts, ends, rows, span_hash(prefix_hash(data, table), starts, ends)


def windows(h: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word, and hash, of each window of k words within a row."""
    if len(h) < k:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    first = np.flatnonzero(rows[k - 1 :] == rows[: len(rows) - k + 1])
    x = np.zeros(len(h) - k + 1, U64)
    for j in range(k):
        x += h[j : len(h) - k + 1 + j] * _MULT[j]
    return first, mix(x[first])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles, A-Z as a-z.

    A row of 1 to k-1 words has one shingle, the whole sequence; a row without words has none.
    Shingles count as equal if their 64-bit hashes are.
    """
    _, _, rows, h = word_hashes(data, offsets)
    n = len(offsets) - 1
    first, x = windows(h, rows, k)
    count = np.bincount(rows, minlength=n)
    bounds = np.searchsorted(rows[first], np.arange(n + 1))
    ends = np.cumsum(count)
    out = []
    for i in range(n):
        if count[i] >= k:
            out.append(np.unique(x[bounds[i] : bounds[i + 1]]))
        elif count[i]:
            own = h[ends[i] - count[i] : ends[i]]
            out.append(mix(np.array([(own * _MULT[32 : 32 + len(own)]).sum(dtype=U64) + U64(len(own))], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out
