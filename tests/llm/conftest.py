import re
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def small_dir():
    """The smallest given tables."""
    return "/root/testdata/sf0.001"


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text) as a documents table with extra columns whose names clash with results."""

    def make(rows):
        whole = [(i, t, "en", f"src{(i or 0) % 3}" if i != 2 else None, len(t or ""), "x", 7) for i, t in rows]
        return spark.createDataFrame(whole, "doc_id long, text string, lang string, source string, n_chars long, score string, size int")

    return make


def words_of(text):
    """Words with A-Z lower-cased, the plain way."""
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def shingle_set(text, k):
    w = words_of(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def classes_of(sets):
    """Smallest member that links of Jaccard 0.8 or more reach, for (key -> set); empty sets alone."""
    part = {k: k for k in sets}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                part[max(p, q)] = min(p, q)
    return {k: find(k) for k in keys}
