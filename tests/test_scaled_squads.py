"""Squads and rosters at many dates: what is looked up and copied does not grow with teams times dates; results are those of single dates."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from matchframe.operators import asof, squads
from tests.conftest import rows

DAY = date(2000, 12, 20)


@pytest.fixture
def market(spark):
    """Values at any hour, some null; spells, some without an end."""
    rng = random.Random(5)
    at = lambda: datetime(2000, 11, 1) + timedelta(hours=12 * rng.randrange(160))
    values = {(p, at()): (None if rng.random() < 0.1 else float(rng.randrange(1, 9))) for p in range(60) for _ in range(5)}
    spells = [(p, s := at(), None if rng.random() < 0.2 else s + timedelta(hours=12 * rng.randrange(9))) for p in range(0, 60, 2) for _ in range(2)]
    return (
        spark.createDataFrame([(p, t, v) for (p, t), v in values.items()] + [(None, datetime(2000, 1, 1), 5.0), (1, None, 9.0)], "player_id long, date timestamp_ntz, value double"),
        spark.createDataFrame(spells, "player_id long, from_date timestamp_ntz, end_date timestamp_ntz"),
    )


def test_rosters_on_match_dates_are_those_of_each_single_date(spark, market, monkeypatch):
    rng = random.Random(6)
    roster = spark.createDataFrame(
        [(t, c, 100 + p, rng.choice([True, False, False, None])) for t in (1, 2, 3) for c in (7, 8) for p in rng.sample(range(60), 25)],
        "team long, tournament int, roster_id long, is_gk boolean",
    )
    links = spark.createDataFrame([(100 + p, p if p % 9 else None) for p in range(58)], "roster_id long, player_id long")
    people = spark.createDataFrame([(100 + p, date(1970 + p % 20, 1, 1) if p % 7 else None) for p in range(60)], "roster_id long, birth_date date")
    # dates of tournament 7 lie in two years
    games = [(i, *rng.sample([1, 2, 3, 4], 2), datetime.combine(DAY + timedelta(days=rng.randrange(20)), datetime.min.time()) if i else None, rng.choice([7, 8, None])) for i in range(30)]
    matches = spark.createDataFrame(games, "match_id long, home_team long, away_team long, date timestamp_ntz, cup int")
    entered = []
    plain = squads.squad_features
    monkeypatch.setattr(squads, "squad_features", lambda players, *a, **k: entered.append(players.count()) or plain(players, *a, **k))
    got = squads.roster_features_for_matches(matches, roster, links, people, *market, min_matched=3, tournament="cup", top_n=2, n_gk=1)
    monkeypatch.undo()
    wanted = matches.select(F.explode(F.array("home_team", "away_team")).alias("team"), F.col("cup").alias("tournament"), F.to_date("date").alias("as_of")).distinct()
    dated = roster.join(wanted, ["team", "tournament"])
    each = squads.roster_features(dated, links, people, *market, top_n=2, n_gk=1).filter("not missing and n_matched >= 3")
    cols = ["top_n_value", "outfield_mean_age", "gk_mean_age", "top1_share", "injured_value_share", "injured_top1", "injured_top3_share", "n_matched"]
    keyed = matches.withColumn("_day", F.to_date("date"))
    expected = squads.attach_to_sides(keyed, each, {"cup": "tournament", "_day": "as_of"}, "team", cols).drop("_day")
    assert rows(got.select(*expected.columns)) == rows(expected)
    assert got.filter("home_top_n_value is not null and away_injured_value_share > 0").count() > 2
    assert entered[0] < dated.count()  # rosters are not copied to dates


def test_a_player_of_many_teams_is_looked_up_once_a_date(spark, market, monkeypatch):
    appearances = spark.createDataFrame([(t, p) for t in range(6) for p in range(60)] * 2, "team_id long, player_id long")
    profiles = spark.createDataFrame([(p, date(1960 + p % 30, 1, 1) if p % 8 else None, "Goalkeeper" if p % 5 == 0 else None) for p in range(60)], "player_id long, date_of_birth date, main_position string")
    snaps = spark.createDataFrame([(t, d) for t in range(7) for d in (DAY, date(2001, 1, 5))] + [(1, None)], "team_id long, snapshot date")
    asked = []
    plain = squads.known_at
    monkeypatch.setattr(squads, "known_at", lambda pairs, *a, **k: asked.append(pairs.count()) or plain(pairs, *a, **k))
    got = squads.historical_squad_value(snaps, appearances, profiles, *market, top_n=4, n_gk=1)
    assert asked == [got.agg(F.sum("n_eligible")).first()[0] // 6]
    pool = asof.eligible_at(snaps, appearances, profiles, "team_id", "player_id", "snapshot", squads.age_at(F.col("snapshot"), F.col("date_of_birth")), "date_of_birth")
    pool = pool.withColumn("is_gk", F.coalesce(F.col("main_position") == "Goalkeeper", F.lit(False))).select("team_id", "snapshot", "player_id", "age", "is_gk")
    valued = squads._valued(pool, market[0], "snapshot", ["team_id", "player_id"], [], market[1])
    expected = squads.squad_features(valued.filter("value is not null"), ["team_id", "snapshot"], 4, 1, injured="injured")
    assert rows(got.filter("not missing").select(*expected.columns)) == rows(expected) and expected.count() == 12
    assert got.filter("missing").count() == 3 and got.filter("missing and n_eligible is null and n_players is null").count() == 3
