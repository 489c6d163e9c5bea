"""Words and hashes of whole text columns, computed on Arrow's UTF-8 buffers.

The functions work on blocks of rows of about ``BLOCK`` bytes, so that the memory
of a task does not follow the size of an Arrow batch.  A text longer than that is
a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19

U = np.uint64
_RNG = np.random.default_rng(20240229)
VALUE = _RNG.integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

#: A-Z as a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing; a character beyond ASCII has only bytes from 128.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

#: Bytes of ``[^\x20\x09-\x0D]``.
NON_BLANK = np.ones(256, bool)
NON_BLANK[[32, 9, 10, 11, 12, 13]] = False


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits; a bijection."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


_powers: list[np.ndarray] = []


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, BLOCK + 1)
        with np.errstate(over="ignore"):
            tables = []
            for base in (_BASE, _INVERSE):
                t = np.full(n, U(base))
                t[0] = 1
                tables.append(np.cumprod(t, dtype=U))
        _powers[:] = tables
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n + 1 offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets.astype(np.int64) - int(offsets[0])


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``size`` bytes."""
    data, offsets = buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        end = min(max(end, row + 1), n)
        a, b = offsets[row], offsets[end]
        yield row, end, data[a:b], offsets[row:end + 1] - a
        row = end


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (maximal run of bytes in ``table``) and, per row, the number of words before it."""
    inside = table[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    opens = inside & ~before[:-1]
    opens[cuts] = inside[cuts]
    starts = np.flatnonzero(opens)
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    closes = inside & ~after[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    closes[last] = inside[last]
    ends = np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """64-bit hash of each word's bytes after ``fold``."""
    up, down = power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.empty(len(data) + 1, U)
        total[0] = 0
        np.cumsum(VALUE[fold[data]] * up[:len(data)], dtype=U, out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts])


def hash_words(texts: list[str]) -> np.ndarray:
    """The same hashes for single words, for lookups."""
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    return word_hashes(np.frombuffer(b"".join(data), np.uint8), offsets[:-1], offsets[1:])


def varint(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Little-endian base-128 bytes of non-negative integers, and the end of each value."""
    size = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28, 35, 42, 49, 56):
        more = values >= (1 << bits)
        if not more.any():
            break
        size += more
    end = np.cumsum(size)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    start = end - size
    for k in range(int(size.max()) if len(size) else 0):
        has = size > k
        part = (values[has] >> (7 * k)) & 127
        out[start[has] + k] = part | ((size[has] > k + 1) << 7)
    return out, end


def unvarint(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.int64)
    end = np.flatnonzero(raw < 128)
    start = np.concatenate([[0], end[:-1] + 1])
    shift = np.arange(len(raw)) - np.repeat(start, end - start + 1)
    return np.add.reduceat((raw.astype(np.int64) & 127) << (7 * shift), start)
