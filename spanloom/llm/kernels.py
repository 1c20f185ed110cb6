"""Array kernels over the UTF-8 buffers of Arrow string columns.

Texts stay in one byte buffer; words, hashes and windows are computed for many
documents at once.  White space is space and ``\\t``..``\\r``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_M = 0x9E3779B97F4A7C15 | 1
_M_INV = pow(_M, -1, 1 << 64)
_POW: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; also spreads small integers."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0x632BE59BD9B4E019))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        for k, base in enumerate((_M, _M_INV)):
            a = np.full(max(n, 1 << 16), U64(base & (2**64 - 1)))
            a[0] = 1
            _POW[k] = np.multiply.accumulate(a)
    return _POW[0][:n], _POW[1][:n]


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    _, offs, data = col.buffers()
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    o = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def pieces(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text has a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and word offsets by row."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    ink = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = ~ink[:-1] | edge[1:n]
    start = np.flatnonzero(ink & before)
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = ~ink[1:] | edge[1:n]
    end = np.flatnonzero(ink & after) + 1
    return start, end, np.searchsorted(start, offsets)


#: Bytes that ``slice_hashes`` takes at a time, beside the rest of a slice.
AT_ONCE = 1 << 20


def slice_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte slices, equal for equal bytes wherever they stand.

    Slices in the order of their starts are taken about ``AT_ONCE`` bytes at a
    time: a worker keeps the powers of the longest stretch that it has seen.
    """
    n = len(data)
    if not n or not len(start):
        return np.zeros(len(start), U64)
    if n > 2 * AT_ONCE and len(start) > 1 and (start[1:] >= start[:-1]).all():
        out, lo = np.empty(len(start), U64), 0
        while lo < len(start):
            hi = max(lo + 1, int(np.searchsorted(start, start[lo] + AT_ONCE)))
            at = start[lo]
            out[lo:hi] = _hashes(data[at : end[lo:hi].max()], start[lo:hi] - at, end[lo:hi] - at)
            lo = hi
        return out
    return _hashes(data, start, end)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(data)
    up, down = _powers(n + 1)
    sums = np.empty(n + 1, U64)
    sums[0] = 0
    np.cumsum(BYTE_VALUE[data] * up[:n], out=sums[1:])
    h = (sums[end] - sums[start]) * down[start]
    return mix(h ^ ((end - start).astype(U64) * U64(0xD6E8FEB86659FD93)))


def gram_hashes(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of ``k`` successive word hashes; ``len(h) - k + 1`` of them."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = np.full(m, U64(0x51ED270B + seed))
    for i in range(k):
        out *= U64(0xFF51AFD7ED558CCD)
        out += h[i : i + m]
    return mix(out)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, .. of every slice, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
