"""The edit rate of benchmark items holds at any length."""

import random

import numpy as np

from matchframe.llm import decontaminate
from tests.llm.test_operators import edit_distance_inside, prose


def changed(rng, item, edits):
    out = list(item)
    for p in sorted(rng.sample(range(len(out)), edits), reverse=True):
        out[p : p + 1] = rng.choice([["#"], [], [out[p], "~"]])
    return "".join(out)


def test_long_items_are_found_within_their_rate(spark, documents):
    rng = random.Random(11)
    items = [(1, prose(rng, 400)[:2000]), (2, prose(rng, 40)), (3, prose(rng, 1000)[:5000])]
    texts = [changed(rng, items[0][1], 100), changed(rng, items[0][1], 190), changed(rng, items[2][1], 400), items[1][1]]
    rows = [(k, prose(rng, 30) + " " + t + " " + prose(rng, 30)) for k, t in enumerate(texts)] + [(9, prose(rng, 900)), (10, items[2][1][:4000])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(documents(rows), bench).collect()}
    assert set(got) == {(0, 1), (1, 1), (2, 3), (3, 2)}
    plain = lambda s: bytes(decontaminate.fold(np.frombuffer(s.encode(), np.uint8)))
    assert got[0, 1].distance == edit_distance_inside(plain(items[0][1]), plain(rows[0][1])) > 64
    assert got[2, 3].distance > 64 and got[3, 2].distance == 0
    assert sorted(r.doc_id for r in decontaminate.clean(documents(rows), bench).collect()) == [9, 10]
    assert decontaminate.budget(2000) == 200 and decontaminate.budget(10_000) == 1000


def test_groups_of_the_alignment_do_not_change_it(monkeypatch):
    rng = random.Random(12)
    items = [prose(rng, n)[:size] for n, size in ((10, 60), (100, 700), (200, 1500), (10, 64), (110, 720))]
    bench = decontaminate.Index(list(enumerate(items)))
    texts = ["".join(changed(rng, t, len(t) // 20)) for t in items]
    raw = [decontaminate.fold(np.frombuffer(t.encode(), np.uint8)) for t in texts]
    low, high = (np.array([f * (int(e) + 5) for e in bench.edits], np.int64) for f in (-1, 1))
    whole = decontaminate.align(bench.items, raw, low, high, bench.edits)
    monkeypatch.setattr(decontaminate, "CELLS", 1)
    assert decontaminate.align(bench.items, raw, low, high, bench.edits) == whole and all(whole)
