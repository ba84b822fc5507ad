"""Vectorised work on the UTF-8 bytes of Arrow text columns.

Texts of a batch are taken in chunks of a bounded number of bytes (one text is
never split), so that a worker's memory follows the chunk or the longest text,
not the batch.  A chunk's bytes lie one text after another; `offsets` says where
each begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

#: Bytes with A-Z turned into a-z; all others as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(chars: bytes | range) -> np.ndarray:
    """256 booleans: which bytes belong to the class."""
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


#: Bytes of words between white space (space and tab to carriage return).
NOT_SPACE = ~byte_class(b" \t\n\x0b\x0c\r")
#: Bytes of runs of digits, letters a-z and everything beyond ASCII (after lower-casing).
ALNUM = byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) for runs of rows; null texts are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    all_offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    all_bytes = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(all_offsets, all_offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, all_bytes[all_offsets[lo] : all_offsets[hi]], all_offsets[lo : hi + 1] - all_offsets[lo]
        lo = hi


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True within each text, and where each text's runs begin."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begins = member.copy()
    begins[1:] &= ~member[:-1]
    begins[cut] = member[cut]
    ends = member.copy()
    ends[:-1] &= ~member[1:]
    ends[cut - 1] = member[cut - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, _U), np.ones(1, _U))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        up, down = np.full(size, _BASE, _U), np.full(size, _BASE_INV, _U)
        up[0] = down[0] = 1
        _powers = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit key over all bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; it depends on the bytes and the seed alone."""
    if not len(starts):
        return np.zeros(0, _U)
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], dtype=_U, out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93) + _U(seed * 0x2545F4914F6CDD1D % (1 << 64)))


def ngrams(h: np.ndarray, ptr: np.ndarray, n: int, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n words in a row (skip > 0: of two words with so many between) and where each text's begin."""
    reach = n - 1 if not skip else skip + 1
    total = len(h) - reach
    if total <= 0:
        return np.zeros(0, _U), np.zeros(len(ptr), np.int64)
    seed = _U((n * 0x9E3779B97F4A7C15 + skip * 0xC2B2AE3D27D4EB4F) % (1 << 64))
    if skip:
        out = mix(mix(h[:total] + seed) + h[reach : reach + total])
    else:
        out = h[:total] + seed
        for k in range(1, n):
            out = mix(out) + h[k : k + total]
        out = mix(out)
    sizes = np.diff(ptr)
    ok = np.ones(total, bool)
    ends = ptr[1:]  # positions whose n words would cross into the next text
    for back in range(1, reach + 1):
        at = ends - back
        at = at[(at >= 0) & (at < total)]
        ok[at] = False
    kept = np.maximum(sizes - reach, 0)
    return out[ok], np.concatenate(([0], np.cumsum(kept)))


def row_sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sum of each text's values; 0.0 where there are none."""
    c = np.concatenate(([0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)))
    return c[ptr[1:]] - c[ptr[:-1]]


def row_of(ptr: np.ndarray) -> np.ndarray:
    """The text of each item."""
    return np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))


def code_points(data: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Code points of each text."""
    return row_sums(((data & 0xC0) != 0x80).astype(np.int64), ptr)
