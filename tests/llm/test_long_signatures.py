"""Signatures of very long texts."""

import numpy as np

from matchframe.llm import minhash, near_dedup


def test_unrelated_long_texts_share_no_key():
    """Twenty sets of 20,000 shingles, and ten of 100,000: no symbol is alike by the size of the set."""
    rng = np.random.default_rng(9)
    for n, size in ((20, 20_000), (10, 100_000)):
        sets = [rng.integers(0, 2**64, size, dtype=np.uint64) for _ in range(n)]
        rows = np.repeat(np.arange(n), size)
        low = minhash.minima(rows, np.concatenate(sets), n, near_dedup.SYMBOLS)
        keys = near_dedup.chunk_keys(near_dedup.symbols_of(low))
        assert len(np.unique(keys)) == keys.size


def test_symbols_are_even():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**64, 5000, dtype=np.uint64) for _ in range(40)]
    low = minhash.minima(np.repeat(np.arange(40), 5000), np.concatenate(sets), 40, near_dedup.SYMBOLS)
    symbols = near_dedup.symbols_of(low)
    assert abs(symbols.mean() / 2**16 - 0.5) < 0.05 and len(np.unique(symbols)) > 0.95 * symbols.size


def test_pairs_near_the_threshold_meet():
    """Of pairs of similarity 0.8 to 0.85 all share a key, whatever the size of the sets."""
    rng = np.random.default_rng(3)
    for size in (40, 400, 20_000):
        met = 0
        for _ in range(20):
            a = rng.integers(0, 2**64, size, dtype=np.uint64)
            b = np.concatenate([a[: int(size * 0.9)], rng.integers(0, 2**64, size - int(size * 0.9), dtype=np.uint64)])
            low = minhash.minima(np.repeat([0, 1], size), np.concatenate([a, b]), 2, near_dedup.SYMBOLS)
            x, y = near_dedup.chunk_keys(near_dedup.symbols_of(low))
            met += bool(np.intersect1d(x, y).size)
        assert met == 20
