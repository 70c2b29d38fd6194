"""Ranked search, fingerprints and vector codes against brute force, and their odd cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from matchframe.llm import codebooks, fingerprints, ranked
from tests.llm.conftest import shingle_set

WORDS = ["alpha", "Beta", "gamma-ray", "delta", "épée", "zeta", "the", "of", "ÉCOLE", "x1", "river,", "stone."]


def prose(rng, n, most=60):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(most)) for _ in range(n))


# --- ranked search


def terms_of(text):
    lowered = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def plain_search(docs, items, wanted=50):
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms_of(t))
    out = []
    for item, terms in asked.items():
        found = []
        for i, c, n in held:
            m = 100 - 50 + (50 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                found.append((-s, i is None, i))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(found[:wanted])]
    return Counter(out)


@pytest.fixture(scope="module")
def texts():
    """Near copies in a large group, ties, nulls, empty and signs only, a very long text and a repeated row."""
    rng = random.Random(3)
    base = prose(rng, 40)
    rows = []
    for i in range(260):
        if i % 3 == 0:
            t = base.split(" ")
            for _ in range(rng.randrange(3)):
                t[rng.randrange(len(t))] = prose(rng, 1)
            rows.append((i, " ".join(t)))
        else:
            rows.append((i, prose(rng, rng.randrange(1, 80))))
    rows += [(900, None), (901, ""), (902, "-- .. !"), (903, prose(rng, 30000)), (904, rows[0][1]), (904, rows[0][1]), (None, rows[0][1])]
    return rows


ITEMS = [(0, "Alpha3 épée7 river,5 the9"), (1, None), (2, ""), (3, "nowhere-at-all qqq"), (4, "stone.1 stone.1 STONE.1 x14"), (4, "zeta2 of2")]


def searched(spark, documents, texts, items, **options):
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, rank int, score int")
    found = ranked.search(documents(texts), asked, **options)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return Counter(tuple(r) for r in found.collect())


@pytest.mark.parametrize("wanted", [3, 50])
def test_search_is_that_of_all_scores(spark, documents, texts, wanted):
    items = ITEMS + [(k, texts[k][1]) for k in (12, 33, 100)]
    assert searched(spark, documents, texts, items, wanted=wanted) == plain_search(texts, items, wanted)


def test_search_of_nothing(spark, documents, texts):
    assert not searched(spark, documents, [], ITEMS)
    assert not searched(spark, documents, texts, [])
    assert not searched(spark, documents, [(1, None), (2, "")], ITEMS)


def test_search_in_several_blocks_of_items(spark, documents, texts, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_BYTES", 300)
    items = ITEMS + [(k, texts[k][1]) for k in (12, 33)]
    assert searched(spark, documents, texts, items, wanted=5) == plain_search(texts, items, 5)


def test_summaries_bound_all_scores_and_skip_blocks():
    rng = np.random.default_rng(2)
    n, n_terms = 4000, 300
    # documents of ten subjects, each with words of its own besides common ones
    terms = [np.unique(np.concatenate([rng.integers(0, 100, 8), 100 + 20 * (d % 10) + rng.integers(0, 20, 10)])) for d in range(n)]
    edge = np.concatenate([[0], np.cumsum([len(t) for t in terms])])
    flat = np.concatenate(terms)
    segment = ranked.Segment(np.arange(n), np.zeros(n, bool), edge, flat, rng.integers(1, 1000, len(flat)))
    asked = [rng.choice(n_terms, 12, replace=False) for _ in range(6)]
    weights = np.zeros((n_terms, 6), np.int64)
    for q, t in enumerate(asked):
        weights[t, q] = rng.integers(1, 5000, 12)
    group = ranked.Group(np.arange(6), np.arange(n_terms), weights)
    dense = np.zeros((n, n_terms), np.int64)
    dense[np.repeat(np.arange(n), np.diff(edge)), flat] = segment.impact
    true = dense @ weights
    cutoff = np.sort(true, axis=0)[-20]
    counts = {}
    pairs = ranked.candidates(segment, group, cutoff, counts)
    reach = np.flatnonzero((true >= cutoff).ravel())
    assert set(reach) <= set(pairs.tolist())
    assert (ranked.scores_of(segment, group, pairs) == true.ravel()[pairs]).all()
    assert counts["skipped"] > 0.3 * counts["blocks"] and len(pairs) < 0.5 * n * 6


def test_segments_of_any_size_give_the_same(spark, documents, texts, monkeypatch):
    known = ranked.Items.of(ITEMS)
    rows = ranked.vectors(documents(texts), known, "doc_id", "text")
    corpus = ranked._corpus(rows, len(known.hashes))
    batches = [pa.RecordBatch.from_pylist([r.asDict() for r in rows.collect()], schema=pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("term", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))]))]
    whole = list(ranked._segments(iter(batches), corpus))
    monkeypatch.setattr(ranked, "SEGMENT", 7)
    monkeypatch.setattr(ranked, "SEGMENT_POSTINGS", 9)
    parts = list(ranked._segments(iter(batches), corpus))
    assert len(whole) == 1 and len(parts) > 10
    assert np.concatenate([p.ids for p in parts]).tolist() == whole[0].ids.tolist()
    assert np.concatenate([p.impact for p in parts]).tolist() == whole[0].impact.tolist()


# --- fingerprints


def plain_hash(words):
    """The shingle hash, the plain way: for shingles of five words and for shorter texts."""
    row, h, _, _ = fingerprints.words(pa.array([" ".join(words)]))
    return int(fingerprints.shingles(row, h, 1, 5)[1][0])


def plain_sketch(text):
    hashes = sorted(plain_hash(s) for s in shingle_set(text, 5))
    return [h for h in hashes if h < 2**64 // 8] or hashes[:1]


def plain_digest(rows):
    texts = {i: t or "" for i, t in rows}
    order = sorted(texts, reverse=True)
    out = {}
    for k, i in enumerate(order):
        t, after = texts[i], texts[order[(k + 1) % len(order)]]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = (plain_sketch(x) for x in (t, edited, after))
        like = lambda x, y: 1.0 if not x and not y else len(set(x) & set(y)) / max(1, min(len(x), len(y)))
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{h:016x}" for h in a), "".join(f"{h:016x}" for h in b), like(a, b), like(a, c), len(shingle_set(t, 5)))
    return out


@pytest.fixture(scope="module")
def prints():
    rng = random.Random(8)
    rows = [(3 * i, prose(rng, rng.randrange(1, 120))) for i in range(50)]
    return rows + [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "ünïcödé 漢字 text 🎈🎈 of five words and more"), (505, prose(rng, 20000)), (-7, rows[3][1]), (-8, rows[3][1])]


@pytest.mark.parametrize("bucket", [1 << 25, 3000])
def test_fingerprints_of_texts_and_edited_texts(spark, documents, prints, monkeypatch, bucket):
    monkeypatch.setattr(fingerprints, "BUCKET_BYTES", bucket)
    got = fingerprints.digest(documents(prints)).collect()
    want = plain_digest(prints)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == pytest.approx(want[r.doc_id]), r.doc_id
    by = {r.doc_id: r for r in got}
    assert by[-7].fingerprint == by[-8].fingerprint == by[9].fingerprint and by[-7].near_next == 1.0
    assert by[501].fingerprint == by[500].fingerprint == by[502].fingerprint == "" and by[501].near_next == 1.0


def test_fingerprints_of_odd_tables(spark, documents):
    assert fingerprints.digest(documents([])).collect() == []
    (alone,) = fingerprints.digest(documents([(5, "a single text of seven plain words")])).collect()
    assert alone.near_next == 1.0 and alone.n_shingles == 3
    twice = fingerprints.digest(documents([(1, "x y z"), (1, "x y z"), (None, "q"), (None, "r"), (2, "x y z")])).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.near_next) for r in twice if r.doc_id) == [(False, 1, 0.0), (False, 1, 1.0), (False, 2, 1.0)]
    assert sum(r.doc_id is None for r in twice) == 2


def test_sketches_merge_and_estimate_containment(spark, documents):
    rng = random.Random(4)
    small, large = prose(rng, 3000, 9000), prose(rng, 9000, 9000)
    rows = [(1, small), (2, large), (3, f"{small}\n{large}"), (4, ""), (5, "few words only")]
    got = {r.doc_id: r for r in fingerprints.sketches(documents(rows)).collect()}
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(shingle_set(t, 5)) for i, t in rows}
    pair = fingerprints.sketches(documents(rows)).alias("a").crossJoin(fingerprints.sketches(documents(rows)).alias("b"))
    pair = pair.select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"), fingerprints.containment(F.col("a.sketch"), F.col("b.sketch")).alias("share"), fingerprints.union_of(F.col("a.sketch"), F.col("b.sketch")).alias("both"))
    pairs = {(r.a, r.b): r for r in pair.collect()}
    sets = {i: shingle_set(t, 5) for i, t in rows}
    for a, b in ((1, 3), (3, 1), (2, 3), (3, 2), (1, 2)):
        assert pairs[a, b].share == pytest.approx(len(sets[a] & sets[b]) / len(sets[a]), abs=0.06)
    # the union of the two differs from their text by the shingles over the seam
    assert len(set(pairs[1, 2].both) ^ set(got[3].sketch)) <= 4
    assert pairs[4, 1].share == 1.0 and pairs[1, 4].share == 0.0 and pairs[4, 5].both == got[5].sketch == pairs[5, 4].both
    assert sorted(pairs[5, 1].both) == sorted(got[1].sketch)


# --- vector codes


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = len(kept[0][2])
    cut = [v[dim * p // parts : dim * (p + 1) // parts] for _, _, v in kept for p in range(parts)]
    part = lambda k, p: cut[k * parts + p]
    seeds = sorted({i: k for k, (i, _, _) in reversed(list(enumerate(kept))) if i is not None}.items())[:entries]
    books = [[list(part(k, p)) for _, k in seeds] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    near = lambda k, p: min((far(part(k, p), y), e) for e, y in enumerate(books[p]))
    for _ in range(rounds):
        given = [[near(k, p)[1] for k in range(len(kept))] for p in range(parts)]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [part(k, p) for k in range(len(kept)) if given[p][k] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    sha = hashlib.sha256(",".join(str(v) for b in books for y in b for v in y).encode()).hexdigest()
    final = [[near(k, p) for p in range(parts)] for k in range(len(kept))]
    error = [sum(d for d, _ in f) for f in final]
    by = Counter()
    for (_, label, _), e in zip(kept, error, strict=True):
        by[label] += e
    return Counter((i, "".join(f"{e:02x}" for _, e in f), d, by[label], sha) for (i, label, _), f, d in zip(kept, final, error, strict=True))


def vectors_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, code int, error string")


def test_codes_are_those_of_all_distances(spark):
    rng = random.Random(6)
    rows = [(2000 - 7 * k, [rng.gauss(0, 0.3) if rng.random() < 0.9 else 0.0 for _ in range(32)], rng.choice([1, 2, None])) for k in range(150)]
    rows += [(k + 3000, list(rows[k][1]), 1) for k in range(40)] + [rows[5], (7001, None, 1), (7002, [None] + [0.0] * 31, 1), (7003, [float("nan")] * 32, 2), (7004, [float("inf")] * 32, 2)]
    got = Counter(tuple(r) for r in codebooks.digest(vectors_of(spark, rows)).collect())
    assert got == plain_codes(rows)


def test_codes_of_few_and_odd_vectors(spark):
    few = [(k, [0.1 * k, -0.2, 0.3 * k] * 5, k % 2) for k in range(5)]  # 15 components in 16 parts, fewer ids than entries
    assert Counter(tuple(r) for r in codebooks.digest(vectors_of(spark, few)).collect()) == plain_codes(few)
    assert codebooks.digest(vectors_of(spark, [])).collect() == []
    odd = [(1, [1e300, -1e300] * 8, 1), (2, [0.5] * 16, 1), (3, [0.5] * 32, None), (None, [0.25] * 16, None), (None, [0.25] * 48, 9), (4, [], 9)]
    got = {(r.vec_id, r.label_error, r.code) for r in codebooks.digest(vectors_of(spark, odd)).collect()}
    assert len(got) == 6 and {(i, c) for i, _, c in got if i in (2, 3, 4)} == {(2, "01" * 16), (3, "00" * 16), (4, "00" * 16)}
    assert {c for i, _, c in got if i is None} >= {None}  # a length without an id has no codebooks


def test_search_by_sums_looks_at_few_entries_and_misses_none():
    rng = np.random.default_rng(1)
    x, book = rng.integers(-200, 200, (3000, 4)), rng.integers(-200, 200, (64, 4))
    book[9] = book[3]  # equal entries: the lower index
    index, best, taken = codebooks.nearest(x, book)
    all_ = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (index == all_.argmin(axis=1)).all() and (best == all_.min(axis=1)).all() and taken < 0.7 * x.shape[0] * 64
    codes, error = codebooks.encode(x, [book[:, :2], book[:, 2:]])
    assert (((codebooks.decode(codes, [book[:, :2], book[:, 2:]]) - x) ** 2).sum(axis=1) == error).all()
