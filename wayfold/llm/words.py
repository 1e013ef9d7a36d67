"""Word hashes of whole Arrow batches, on numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; a longer document goes alone.
STEP = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words between white space: [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
#: Words of letters: ASCII letters and all bytes of other characters.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True

C1, C2, C3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
S27, S31, S32 = np.uint64(27), np.uint64(31), np.uint64(32)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which each bit depends on all; works in place."""
    h ^= h >> S31
    h *= C1
    h ^= h >> S27
    h *= C2
    h ^= h >> S32
    return h


def slices(column: pa.Array, step: int = STEP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows: first, one past the last, their bytes (8 spare ones behind), the ends of the rows in them. Null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, (_, ends, data) = len(column), column.buffers()
    if not n:
        return
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + step, "right")) - 1)
        own = np.zeros(offsets[to] - offsets[at] + 8, np.uint8)
        own[:-8] = LOWER[raw[offsets[at] : offsets[to]]]
        yield at, to, own, offsets[at + 1 : to + 1] - offsets[at]
        at = to


def words(own: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word in order, and for each row the number of words up to its end."""
    inside = kind[own]
    inside[-8:] = False
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = ends[(ends > 0) & (ends < len(own) - 8)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    view = np.ndarray((len(own) - 7,), "<u8", own.data, strides=(1,))
    length = stop - start
    h = length.astype(np.uint64) * C3
    rows, k = slice(None), 0
    while len(start):
        rest = np.minimum(length[rows] - 8 * k, 8) if k else np.minimum(length, 8)
        v = view[start[rows] + 8 * k] if k else view[start]
        v = v & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - rest) * 8).astype(np.uint64))
        h[rows] = mix((h[rows] ^ v) + C3)
        k += 1
        rows = np.flatnonzero(length > 8 * k) if k == 1 else rows[length[rows] > 8 * k]
        if not len(rows):
            break
    return h, np.searchsorted(start, ends)
