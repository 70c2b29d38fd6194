"""Ordered operators give the same rows whether or not a key is cut into chunks."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from matchframe.operators import asof, ordered, windows
from matchframe.session import small_table



def day():
    return F.timestamp_add("DAY", F.col("d"), F.lit("2020-01-01").cast("timestamp_ntz"))


@pytest.fixture(scope="module")
def events(spark):
    """400 rows; key 1 holds half of them, many on equal days; some values are missing."""
    rng = random.Random(7)
    data = [
        (i, 1 if i % 2 else rng.randrange(2, 9), rng.randrange(60), None if rng.random() < 0.2 else rng.randrange(100))
        for i in range(400)
    ]
    return small_table(spark, data, "id long, k long, d int, x long").withColumn("date", day()).cache()


def _both(spark, build):
    spark.conf.unset("spark.matchframe.windowBytes")
    plain = rows(build())
    spark.conf.set("spark.matchframe.windowBytes", "0")
    return plain, rows(build())


def test_chunks_are_bounded(spark, events, small_chunks):
    chunked = ordered.range_chunks(events, ["k"], ["date", "id"])
    sizes = [r["count"] for r in chunked.groupBy("k", ordered.CHUNK).count().collect()]
    assert len(sizes) > 8 and max(sizes) < 150 and sum(sizes) == 400


@pytest.mark.parametrize("n", [1, 3, 10, 90])
def test_prior_rows(spark, events, small_chunks, n):
    cols = {"x": "s"}
    plain, cut = _both(spark, lambda: windows.rolling_prior_sum(events, ["k"], ["date", "id"], cols, n, "n"))
    assert plain == cut and len(cut) == 400


def test_rolling_mean_and_rest_days(spark, events, small_chunks):
    def build():
        mean = windows.rolling_prior_mean(events, ["k"], ["date", "id"], {"x": "m"}, 10, 3, "x")
        return windows.days_since_prev(mean, ["k"], "date", ["id"])

    plain, cut = _both(spark, build)
    assert plain == cut


@pytest.mark.parametrize("inclusive", [False, True])
def test_running(spark, events, small_chunks, inclusive):
    values = {"s": ("sum", F.col("x")), "m": ("max", F.col("x")), "l": ("last", F.col("x"))}
    plain, cut = _both(spark, lambda: ordered.running(events, ["k"], ["date", "id"], values, inclusive))
    assert plain == cut


def test_asof_and_spells(spark, events, small_chunks):
    left = events.filter("id % 3 = 0").select("id", "k", "date")
    right = events.filter("id % 3 > 0").withColumnRenamed("date", "at")
    spells = right.withColumn("until", F.timestamp_add("DAY", F.lit(2), F.col("at")))

    def build():
        found = asof.asof(left, right, ["k"], ["k"], "date", "at", {"x": "x"}, ["id"], ["id"], fallback="earliest")
        return asof.active_interval(found, spells, "k", "date", "at", "until", ["id"])

    plain, cut = _both(spark, build)
    assert plain == cut and len(cut) == left.count()


def test_ledgers(spark, events, small_chunks):
    bets = events.withColumns({"p": F.lit(0.6), "odds": 1.2 + (F.col("id") % 10) / 5, "won": (F.col("id") % 2).cast("int")})

    def build():
        flat = windows.flat_stake_pnl(bets, ["k"], ["date", "id"], "p", "odds", "won")
        kelly = windows.kelly_bankroll(bets, ["k"], ["date", "id"], "p", "odds", "won", fraction=0.1)
        return flat.select("id", "bankroll").join(kelly.select("id", F.col("bankroll").alias("b2")), "id")

    plain, cut = _both(spark, build)
    assert [r[0] for r in plain] == [r[0] for r in cut]
    assert all(abs(a - b) < 1e-6 * max(1, abs(a)) for p, c in zip(plain, cut) for a, b in zip(p, c))


def test_prior_careers(spark, events, small_chunks):
    from matchframe.operators import careers

    results = events.select(
        F.col("k").alias("coach"), (F.col("id") % 4).alias("event"), F.col("date").alias("match_date"),
        (F.col("id") % 2).alias("win"), (F.col("id") % 3 == 0).cast("int").alias("draw"),
    )
    plain, cut = _both(spark, lambda: careers.prior_career(results, "coach", "event"))
    assert plain == cut and len(cut) == results.select("coach", "event").distinct().count()
