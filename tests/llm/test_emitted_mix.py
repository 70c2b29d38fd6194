"""The pipeline's last stage gives the mixed corpus itself, a row for each copy."""

from collections import Counter

import corpus_pipeline
from matchframe.llm import mixing
from tests.llm.conftest import words_of


def test_emitted_words_meet_the_targets(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)["mixing sources to target weights"]
    emitted = stage(spark, docs, small_dir).collect()
    told = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert any(r.copies == 0 for r in told.values()) and any(r.copies > 1 for r in told.values())
    assert sorted((r.doc_id, r["copy"]) for r in emitted) == sorted((i, k + 1) for i, r in told.items() for k in range(r.copies))
    assert all(r.text == told[r.doc_id].text for r in emitted)
    given, target = Counter(), {r.source: r.target for r in told.values()}
    for r in emitted:
        given[r.source] += len(words_of(r.text))
    largest = max(r.size for r in told.values())
    assert all(abs(given[s] - target[s]) <= 2 * largest for s in target)


def test_emit_of_nothing_and_of_a_column_named_copy(spark, documents):
    assert mixing.emit(documents([])).collect() == []
    rows = mixing.emit(documents([(1, "a b c"), (2, None)]).withColumnRenamed("lang", "copy")).collect()
    assert {r["copy"] for r in rows} <= {1, 2} and all(r.copies >= r["copy"] for r in rows)
