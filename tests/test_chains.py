"""Rating chains in components: against a plain fold, and how many tasks they make."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from matchframe.operators import chains, ratings
from matchframe.session import small_table

SCHEMA = "match_id long, day string, league string, home_team int, away_team int, home_score int, away_score int"


def log_of(spark, played):
    df = small_table(spark, played, SCHEMA)
    return df.select("match_id", F.col("day").cast("timestamp_ntz").alias("date"), "league", "home_team", "away_team", "home_score", "away_score", F.lit(False).alias("neutral"), F.lit("Friendly").alias("tournament"))


@pytest.fixture(scope="module")
def played():
    """Ten groups of teams a league that never meet; some groups rest for years in which others play."""
    rng, out = random.Random(2), []
    for k in range(900):
        league, group = rng.choice("xy"), rng.randrange(10)
        year = rng.choice([2015, 2017, 2018, 2020]) if group % 3 else rng.choice([2015, 2020])
        a, b = rng.sample(range(5), 2)
        day = date(year, 1, 1) + timedelta(days=rng.randrange(365))
        out.append((k, str(day), league, 10 * group + a, 10 * group + b, rng.randrange(5), rng.randrange(4)))
    return out + [(900, "2016-03-01", "x", 777, 778, 1, 0), (901, "2019-03-01", "y", 5, 5, 1, 0)]


def plain_fold(played, p=ratings.RatingParams()):
    """Pre-match ratings and the last state, one league after the other, match by match."""
    rows, state = {}, {}
    for league in {r[2] for r in played}:
        held, year = {}, None
        for m, day, _, home, away, hs, as_ in sorted((r for r in played if r[2] == league), key=lambda r: (r[1], r[0])):
            y = int(day[:4])
            if year is not None and y > year:
                held = {t: p.initial + (1 - p.regression) * (r - p.initial) for t, r in held.items()}
            year = y if year is None else max(year, y)
            a, b = held.get(home, p.initial), held.get(away, p.initial)
            chance = 1 / (1 + 10 ** ((b - a - p.home_advantage) / 400))
            gap = abs(hs - as_)
            k = p.k * min(0.75 * (1 if gap <= 1 else 1.5 if gap == 2 else 1.75 + (gap - 3) / 8), 2.0)
            won = 1.0 if hs > as_ else 0.5 if hs == as_ else 0.0
            rows[m] = (a, b)
            held[home] = a + k * (won - chance)
            held[away] = b + k * (chance - won)
        state |= {(league, t): r for t, r in held.items()}
    return rows, state


def close(got, want):
    assert got.keys() == want.keys()
    assert all(abs(x - y) < 1e-6 for k in want for x, y in zip(got[k], want[k], strict=True))


def pre(df):
    return {r.match_id: (r.home_elo_pre, r.away_elo_pre) for r in df.collect()}


def test_chains_of_components_equal_the_plain_fold(spark, played):
    matches = log_of(spark, played)
    rows, state = plain_fold(played)
    close(pre(ratings.elo_fold(matches)), rows)
    final = ratings.last_state(ratings.elo_states(matches)).collect()
    close({(r.key, r.team): (r.r0,) for r in final}, {k: (v,) for k, v in state.items()})


@pytest.mark.parametrize("starts", [[2018], [2016, 2017, 2019], [date(2015, 6, 1), date(2017, 2, 3), 2020], [2030]])
def test_periods_with_components_of_their_own(spark, played, starts):
    matches = log_of(spark, played)
    rows, state = plain_fold(played)
    got, final = ratings.fold_in_periods(matches, starts)
    close(pre(got), rows)
    close({(r.key, r.team): (r.r0,) for r in final.collect()}, {k: (v,) for k, v in state.items()})


def test_states_at_the_end_of_every_year_of_the_league(spark, played):
    """A group that rests still gets a state for each year its league plays in, pulled to the mean like the others."""
    states = ratings.elo_states(log_of(spark, played)).collect()
    for league in "xy":
        years = sorted({int(r[1][:4]) for r in played if r[2] == league})
        for k, year in enumerate(years):
            so_far = [r for r in played if int(r[1][:4]) <= year]
            want = {t: v for (name, t), v in plain_fold(so_far)[1].items() if name == league}
            own = {r.team: r for r in states if (r.key, r.year) == (league, year)}
            assert {r.next_year for r in own.values()} == {years[k + 1] if k + 1 < len(years) else None}
            close({t: (r.r0,) for t, r in own.items()}, {t: (v,) for t, v in want.items()})


def test_more_tasks_than_leagues(spark, played):
    """Components, not leagues, are what tasks are made of."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        folded = ratings.elo_fold(log_of(spark, played)).select("key", F.spark_partition_id().alias("task"))
        tasks = folded.groupBy("key").agg(F.countDistinct("task").alias("n")).collect()
        assert len(tasks) == 2 and all(r.n >= 6 for r in tasks)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(5)
    path = [("p", i, i + 1) for i in range(70)]
    loop = [("l", i, (i + 1) % 30) for i in range(30)]
    star = [("s", 0, i) for i in range(1, 200)] + [("s", 500, 501)]
    odd = [("o", 3, 3), ("o", None, 4), ("o", 5, None)]
    mess = [("m", rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    pairs = path + loop + star + odd + mess
    rng.shuffle(pairs)
    got = {(r.key, r.team): r.component for r in chains.components(small_table(spark, pairs, "g string, u int, v int"), "g", "u", "v").collect()}
    want = {}
    for g, u, v in pairs:
        if u is not None and v is not None:
            want.setdefault((g, u), u), want.setdefault((g, v), v)
    moved = True
    while moved:
        moved = False
        for g, u, v in pairs:
            if u is not None and v is not None and want[g, u] != want[g, v]:
                want[g, u] = want[g, v] = min(want[g, u], want[g, v])
                moved = True
    assert got == want
    assert chains.components(small_table(spark, [], "g string, u int, v int"), "g", "u", "v").collect() == []


def test_empty_log_and_log_without_some_teams(spark, played):
    assert ratings.elo_fold(log_of(spark, [])).collect() == []
    assert ratings.elo_fold(log_of(spark, [(1, "2020-01-01", "x", None, 2, 1, 0), (2, "2020-01-02", "x", 2, 3, 1, 0)])).count() == 2
