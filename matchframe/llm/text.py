"""Words, hashes and shingles of whole Arrow batches, without a Python loop over words.

A word is a maximal run of bytes other than space and 0x09-0x0D, with A-Z lower-cased. Its hash is a 64-bit polynomial
over the word's bytes, mixed; the polynomial of any span is a difference of prefix sums, so a batch costs a few array
passes whatever its words look like. Equal words have equal hashes; unequal ones collide with probability about 2^-60.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are turned into arrays at a time (a longer document is taken alone).
PIECE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_LETTERS = np.arange(256, dtype=np.uint64)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    h = np.asarray(h, dtype=np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mix(_LETTERS[LOWER] + np.uint64(0x51ED2701))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for b in (_BASE, inverse):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string array; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column) or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose text has ``limit`` bytes at most, or that are one row."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, done = 0, 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at, done = to, int(sizes[to - 1])


def words(column: pa.Array, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, start, end) of every word, in order; starts and ends are bytes of the whole batch.

    ``space`` tells of each byte whether it separates words.
    """
    data, offsets = bytes_of(column)
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~space[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:n]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    power, inverse = _powers(1 << max(16, int(n - 1).bit_length()))
    sums = _BYTE[data]
    sums *= power[:n]
    np.cumsum(sums, out=sums)
    h = sums[ends - 1]
    h[starts > 0] -= sums[starts[starts > 0] - 1]
    h *= inverse[starts]
    rows = np.searchsorted(offsets[1:], starts, side="right")
    return rows, mix(h), starts, ends


def shingles(rows: np.ndarray, hashes: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of ``size`` words of every row, sorted by both.

    A row with fewer words, but at least one, has its whole sequence as its only shingle.
    """
    odd = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    count = np.bincount(rows, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    m = len(hashes) - size + 1
    parts = []
    if m > 0:
        inside = rows[:m] == rows[size - 1 :]
        h = np.zeros(m, np.uint64)
        for j in range(size):
            h += hashes[j : j + m] * odd[j]
        parts.append((rows[:m][inside], mix(h[inside])))
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        h = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            has = count[short] > j
            h[has] += hashes[first[short[has]] + j] * odd[j]
        parts.append((short, mix(h + count[short].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    r, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((h, r))
    r, h = r[order], h[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return r[new], h[new]


def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from every place, a difference of prefix sums as in ``words``."""
    m = max(0, len(hashes) - size + 1)
    power, inverse = _powers(1 << max(16, int(len(hashes)).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[: len(hashes)], dtype=np.uint64)])
    return mix((sums[size : size + m] - sums[:m]) * inverse[:m])


def release() -> None:
    """Give freed memory back to the machine; a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def blobs(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary value per row from the concatenated values of all rows."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * flat.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())
