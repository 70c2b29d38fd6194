"""Flattening of nested bodies. Each body is one row; nothing is grouped to flatten it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchframe.functions.constants import STATISTIC_COLUMNS
from matchframe.functions.text import coerce_stat
from matchframe.sources.schemas import FIXTURE_BODY, LINEUPS_BODY, RANKING_BODY, STATISTICS_BODY


def flatten_fixtures(
    df: DataFrame, fixture_json: str = "fixture_json", lineups_json: str = "lineups_json",
    league: str = "league_id", season: str = "season",
) -> DataFrame:
    """One row per (fixture, team) from a fixture body and its lineup body; fixtures without lineups are dropped."""
    parsed = df.select(
        league, season,
        F.from_json(fixture_json, FIXTURE_BODY).alias("f"),
        F.from_json(lineups_json, LINEUPS_BODY).alias("l"),
    )
    rows = parsed.select(league, season, "f", F.explode("l.response").alias("u"))
    return rows.select(
        F.col("f.fixture.id").alias("fixture_id"),
        league,
        season,
        F.col("f.fixture.date").alias("date_utc"),
        F.col("f.fixture.venue.name").alias("venue"),
        F.col("f.teams.home.id").alias("home_team_id"),
        F.col("f.teams.home.name").alias("home_team_name"),
        F.col("f.teams.away.id").alias("away_team_id"),
        F.col("f.teams.away.name").alias("away_team_name"),
        F.col("u.team.id").alias("team_id"),
        F.col("u.team.name").alias("team_name"),
        F.col("u.team.id").eqNullSafe(F.col("f.teams.home.id")).alias("is_home"),
        F.col("u.formation").alias("formation"),
        F.col("u.coach.id").alias("coach_id"),
        F.col("u.coach.name").alias("coach_name"),
        F.col("f.goals.home").alias("home_goals"),
        F.col("f.goals.away").alias("away_goals"),
    )


def flatten_rosters(df: DataFrame, fixture: str = "fixture_id", lineups_json: str = "lineups_json") -> DataFrame:
    """One row per listed player, starters and substitutes in one pass over the body."""
    sides = df.select(
        fixture, F.explode(F.from_json(lineups_json, LINEUPS_BODY)["response"]).alias("u")
    )

    def tagged(slot: str, starter: bool) -> Column:
        entries = F.coalesce(F.col(f"u.{slot}"), F.array())
        return F.transform(entries, lambda e: F.struct(e["player"].alias("p"), F.lit(starter).alias("starter")))

    listed = F.concat(tagged("startXI", True), tagged("substitutes", False))
    players = sides.select(fixture, F.col("u.team.id").alias("team_id"), F.explode(listed).alias("e"))
    return players.select(
        fixture,
        "team_id",
        F.col("e.p.id").alias("player_id"),
        F.col("e.p.name").alias("player_name"),
        F.col("e.p.number").alias("number"),
        F.col("e.p.pos").alias("pos"),
        F.col("e.p.grid").alias("grid"),
        F.col("e.starter").alias("is_starter"),
    )


def flatten_statistics(
    df: DataFrame, fixture: str = "fixture_id", statistics_json: str = "statistics_json",
    mapping: dict[str, str] | None = None,
) -> DataFrame:
    """One row per (fixture, team) with a numeric column per known statistic.

    The last value of a repeated type wins, other types are ignored. No shuffle: the pairs are in the row.
    """
    mapping = mapping or STATISTIC_COLUMNS
    sides = df.select(fixture, F.explode(F.from_json(statistics_json, STATISTICS_BODY)["response"]).alias("u"))
    newest_first = sides.select(
        fixture, F.col("u.team.id").alias("team_id"),
        F.reverse(F.col("u.statistics.type")).alias("_types"), F.reverse(F.col("u.statistics.value")).alias("_values"),
    )
    raw = {name: F.get("_values", (F.array_position("_types", kind) - 1).cast("int")) for kind, name in mapping.items()}
    texts = newest_first.select(fixture, "team_id", *[c.alias(name) for name, c in raw.items()])
    return texts.withColumns({name: coerce_stat(F.col(name)) for name in raw})


def kv_to_wide(
    df: DataFrame, keys: list[str], key: str, value: str, position: list[str], mapping: dict[str, str]
) -> DataFrame:
    """Key/value rows to fixed columns; per (entity, key) the last value by ``position`` wins.

    ``max_by`` combines on the map side, so an entity with very many rows ships one value per key and task.
    """
    known = df.filter(F.col(key).isin(list(mapping)))
    at = F.struct(*position)
    return known.groupBy(*keys).agg(
        *[F.max_by(F.col(value), F.when(F.col(key) == k, at)).alias(name) for k, name in mapping.items()]
    )


def flatten_rankings(df: DataFrame, body: str = "body", rank_date: str = "rank_date") -> DataFrame:
    """Ranking bodies to eight flat columns; the first listed team name is used."""
    rows = df.select(rank_date, F.explode(F.from_json(body, RANKING_BODY)["Results"]).alias("r"))
    return rows.select(
        F.col("r.Rank").alias("rank"),
        F.try_element_at(F.col("r.TeamName"), F.lit(1))["Description"].alias("country_full"),
        F.col("r.IdCountry").alias("country_abrv"),
        F.col("r.TotalPoints").alias("total_points"),
        F.col("r.PrevPoints").alias("previous_points"),
        F.col("r.RankingMovement").alias("rank_change"),
        F.col("r.ConfederationName").alias("confederation"),
        F.col(rank_date).alias("rank_date"),
    )
