"""Passages of 50 words or more are found whatever lines they stand on."""

import random
from collections import defaultdict

from matchframe.llm import passages
from tests.llm.conftest import words_of
from tests.llm.test_operators import prose


def broken(rng, text, most):
    """``text`` on lines of up to ``most`` words."""
    w, out = text.split(" "), []
    while w:
        n = rng.randrange(1, most + 1)
        out.append(" ".join(w[:n]))
        w = w[n:]
    return "\n".join(out)


def test_every_repeated_run_is_covered(spark, documents):
    rng = random.Random(21)
    shared = [prose(rng, n) for n in (50, 69, 54, 130, 49)]
    rows = []
    for i in range(40):
        t = " ".join([prose(rng, rng.randrange(30)), shared[i % 5], prose(rng, rng.randrange(1, 40))]).strip()
        rows.append((i, broken(rng, t, 30) if i % 2 else t))
    rows += [(40, None), (41, ""), (42, rows[1][1]), (3, rows[3][1]), (43, broken(rng, " ".join([shared[1]] * 3), 9)), (44, "a " * 300)]
    rows += [(45, "é " + rows[1][1])]
    got = passages.repeats(documents(rows)).collect()
    text = dict(rows)
    places = defaultdict(set)
    for i, t in text.items():
        w = words_of(t)
        for k in range(len(w) - 49):
            places[tuple(w[k : k + 50])].add((i, k))
    spans = defaultdict(list)
    for r in got:
        part = text[r.doc_id][r.start : r.end]
        assert len(words_of(part)) == r.n_words >= 50 and part == part.strip()
        assert text[r.doc_id][: r.start].count("\n") == r.paragraph
        before = len(words_of(text[r.doc_id][: r.start]))
        spans[r.doc_id].append((before, before + r.n_words, r.removed, r.unit))
    several = {p for at in places.values() if len(at) > 1 for p in at if p[0] != 44}
    assert several and all(any(a <= k and k + 50 <= b for a, b, *_ in spans[i]) for i, k in several)
    for i, found in spans.items():  # and no run but repeated words
        for a, b, _, unit in found:
            assert unit == "line" or i == 44 or all((i, k) in several for k in range(a, b - 49))
    assert len(spans[44]) == 6 and {(a, b) for a, b, *_ in spans[44]} == {(k, k + 50) for k in range(0, 300, 50)}
    # of every repeated passage one place is left
    for at in places.values():
        gone = [any(a <= k and k + 50 <= b and removed for a, b, removed, _ in spans[i]) for i, k in at]
        assert len(at) == 1 or not all(gone)
    heads = {(r.doc_id, r.paragraph, r.start) for r in got if not r.removed}
    assert all((r.class_doc, r.class_paragraph, r.class_start) in heads for r in got)
    assert passages.repeats(documents([])).collect() == []
