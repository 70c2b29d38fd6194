"""Explicit schemas of the inputs; nothing is inferred."""

from __future__ import annotations

MATCHES = (
    "date timestamp_ntz, home_team string, away_team string, home_score int, away_score int, "
    "tournament string, neutral boolean"
)
FORMER_NAMES = "former string, current string, start_date date, end_date date"
RANKINGS = (
    "rank_date date, country_full string, country_abrv string, rank int, total_points double, "
    "previous_points double, rank_change int, confederation string"
)
APPEARANCES = "player_id long, team_id long, matches int, career_state string"
MARKET_VALUES = "player_id long, date_unix date, value double"
PROFILES = (
    "player_id long, player_name string, citizenship string, date_of_birth string, main_position string, "
    "position string, current_club_id long, current_club_name string"
)
INJURIES = "player_id long, from_date date, end_date date, days_missed int"
TRANSFERS = "player_id long, transfer_date date, from_team_id long, to_team_id long"
CLUBS = "club_id long, competition_id string, competition_name string, country_name string"

# Nested bodies of the fixture, lineup, statistics and ranking sources.
_SIDE = "struct<id: long, name: string>"
_PLAYER = "struct<id: long, name: string, number: int, pos: string, grid: string>"
_ENTRIES = f"array<struct<player: {_PLAYER}>>"
FIXTURE_BODY = (
    "struct<fixture: struct<id: long, date: string, venue: struct<name: string>>, "
    f"teams: struct<home: {_SIDE}, away: {_SIDE}>, goals: struct<home: int, away: int>>"
)
LINEUPS_BODY = (
    f"struct<response: array<struct<team: {_SIDE}, formation: string, coach: {_SIDE}, "
    f"startXI: {_ENTRIES}, substitutes: {_ENTRIES}>>>"
)
STATISTICS_BODY = (
    "struct<response: array<struct<team: struct<id: long>, statistics: array<struct<type: string, value: string>>>>>"
)
RANKING_BODY = (
    "struct<Results: array<struct<Rank: int, TeamName: array<struct<Description: string>>, IdCountry: string, "
    "TotalPoints: double, PrevPoints: double, RankingMovement: int, ConfederationName: string>>>"
)
