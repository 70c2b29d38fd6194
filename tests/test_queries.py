"""Every query against its SQL twin on the given tables; model fits by shape."""

import duckdb
import pytest

import __spark_entry__ as entry
from matchframe.plans import all_queries
from matchframe.plans.views import TABLES

QUERIES = all_queries()
SLOW_FITS = {"boosted_trees", "perceptron", "feature_importances", "sweep_decay_rates"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _sorted(found):
    return sorted((tuple(r) for r in found), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql is not None])
def test_matches_sql(name, spark, duck, sf_dir):
    q = QUERIES[name]
    df = q.run(spark, sf_dir)
    cursor = duck.execute(q.oracle())
    assert [d[0] for d in cursor.description] == df.columns
    assert _sorted(df.collect()) == _sorted(cursor.fetchall())


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql is None and n not in SLOW_FITS])
def test_fit_gives_rows(name, spark, sf_dir):
    assert QUERIES[name].run(spark, sf_dir).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "home_form_wins" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
