"""Values of any length are spanned, priced and masked whole."""

import random
import string
import time

import pyarrow as pa
import pytest

from matchframe.llm import secret_scan
from matchframe.llm.text import PIECE_BYTES


@pytest.mark.parametrize("context", ["private_key: ", "pwd=", "auth => ", "password: %"])
def test_long_values_are_masked_to_their_end(spark, documents, context):
    rng = random.Random(3)
    value = "".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(800))
    text = f"see {context}{value} and more"
    (r,) = secret_scan.scan(documents([(1, text)])).collect()
    assert (text.index(value) + 800) in [s.end for s in r.secret_spans if s.kind == "guess"]
    (r,) = secret_scan.mask(documents([(1, text)])).collect()
    assert value[-20:] not in r.text and r.text.endswith("[secret] and more")


def test_a_long_repeat_costs_time_in_its_length():
    began = time.process_time()
    assert secret_scan.guess_cost("a" * 200_000) < secret_scan.MIN_GUESSES
    assert time.process_time() - began < 30


def test_repeats_reach_as_far_as_their_units_do():
    rng = random.Random(4)
    for _ in range(300):
        v = "".join(rng.choice("abA1") for _ in range(rng.randrange(1, 30)))
        low, want = v.lower(), set()
        for i in range(len(v)):
            for unit in (1, 2, 3, 4):
                j = i + unit
                while j + unit <= len(v) and low[j : j + unit] == low[i : i + unit]:
                    j += unit
                if j - i >= max(3, 2 * unit):
                    want.add((i, j))
        assert {(i, j) for i, j, _, kind in secret_scan.spans_of(v) if kind == "repeat"} == want


def test_texts_are_masked_a_piece_at_a_time():
    texts = [f"{'words of a text ' * 3000}token: kx81Hq0zPw77LmQ2 {i}" for i in range(120)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(120)), pa.array(texts)], names=["doc_id", "text"])
    got = list(secret_scan.masking(1, "text", "[secret]", secret_scan.MIN_GUESSES)(iter([batch])))
    assert max(b.column(1).nbytes for b in got) < 2 * PIECE_BYTES
    assert [t for b in got for t in b.column(1).to_pylist()] == [secret_scan.masked(t) for t in texts]
