"""The registered corpus queries on the smallest given tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from matchframe.llm import decontaminate, mixing, near_dedup
from matchframe.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import classes_of, shingle_set


def test_all_are_registered():
    names = set(entry.queries())
    assert {"pipeline"} < names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, small_dir):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{small_dir}/{t}.parquet'")
    found = con.execute(ORACLES[name])
    df = QUERIES[name](spark, small_dir)
    assert sorted(df.columns) == sorted(d[0] for d in found.description)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in df.select(*[d[0] for d in found.description]).collect()), key=key) == sorted(found.fetchall(), key=key)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"pipeline"}))
def test_gives_rows(name, spark, small_dir):
    df = QUERIES[name](spark, small_dir)
    n = spark.read.parquet(f"{small_dir}/documents.parquet").count()
    rows = df.count()
    assert rows == n if name.split("_")[0] in {"op1", "op2", "op3", "op4", "op6", "op8", "op12"} else rows > 0


def test_pipeline_stages(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, small_dir)
        after = {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before) and (k == 4 or out.columns == columns)
        if k == 1:
            want = classes_of({i: shingle_set(r.text, 5) for i, r in before.items()})
            assert set(after) == {i for i, c in want.items() if i == c}
        if k == 2:
            bench = spark.read.parquet(f"{small_dir}/benchmark.parquet")
            leaked = {r.doc_id for r in decontaminate.matches(docs, bench).collect()}
            assert set(after) == set(before) - leaked
        if k == 3:
            assert set(after) == set(before)
        if k == 4:  # a row for each copy, none for documents that the mix leaves out
            rows = out.collect()
            assert all(sorted(r.copy for r in rows if r.doc_id == i) == list(range(1, after[i].copies + 1)) for i in after)
        docs = out
    assert {"copies", "taken", "target", "source_size"} <= set(docs.columns)
    assert corpus_pipeline.run(spark, small_dir).count() == docs.count()
    assert near_dedup.WORDS == 5 and mixing.SHARE == 1.5
