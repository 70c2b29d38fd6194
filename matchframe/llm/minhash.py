"""MinHash signatures of shingle sets, computed for whole Arrow batches."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from matchframe.llm.text import mix


@lru_cache(maxsize=4)
def _seeds(n: int, tag: int) -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(n, dtype=np.uint64) + np.uint64(tag * 1000003)
    return mix(k * np.uint64(2) + np.uint64(1)) | np.uint64(1), mix(k * np.uint64(2) + np.uint64(977))


def minima(rows: np.ndarray, hashes: np.ndarray, n_rows: int, n: int, tag: int = 0) -> np.ndarray:
    """(n_rows, n) least values of n hash functions over the hashes of every row; ``rows`` is sorted. Empty rows have all ones."""
    out = np.full((n_rows, n), np.iinfo(np.uint64).max, np.uint64)
    if not len(rows):
        return out
    begin = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    odd, add = _seeds(n, tag)
    for k in range(n):
        h = hashes * odd[k]
        h += add[k]
        h ^= h >> np.uint64(32)
        h *= odd[k] ^ np.uint64(0x5851F42D4C957F2C)
        out[rows[begin], k] = np.minimum.reduceat(h, begin)
    return out


#: Places of a sketch, one bit each, and the longs that hold it.
SKETCH_BINS = 512
SKETCH_LONGS = SKETCH_BINS // 64


def sketch(rows: np.ndarray, hashes: np.ndarray, n_rows: int) -> pa.ListArray:
    """One bit of the least hash in each of SKETCH_BINS bins of every row's set (0 where the bin is empty), as longs.

    Two sets agree on the least hash of a bin that either one fills with probability equal to their Jaccard similarity.
    """
    h = mix(hashes ^ np.uint64(0x5EE7C))
    low = np.full(n_rows * SKETCH_BINS, np.iinfo(np.uint64).max, np.uint64)
    shift = np.uint64(SKETCH_BINS.bit_length() - 1)
    np.minimum.at(low, rows * SKETCH_BINS + (h >> (np.uint64(64) - shift)).astype(np.int64), h << shift)
    bits = (mix(low) >> np.uint64(17)) & np.uint64(1)
    bits[low == np.iinfo(np.uint64).max] = 0
    longs = np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(n_rows + 1) * SKETCH_LONGS, pa.int32()), pa.array(longs))


def digest(rows: np.ndarray, hashes: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over the set of every row: equal sets have equal digests."""
    out = []
    for salt in (0xA5A5, 0x5A5A5A):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(salt)), dtype=np.uint64)])
        ends = np.searchsorted(rows, np.arange(n_rows + 1))
        out.append((total[ends[1:]] - total[ends[:-1]]).view(np.int64))
    return out[0], out[1]
