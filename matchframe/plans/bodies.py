"""Nested bodies: JSON is written from the flat tables and flattened again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from matchframe.functions import text
from matchframe.plans.registry import query
from matchframe.session import shared_folder
from matchframe.sources import export, nested, tables


def _bodies(v):
    """One fixture body and one lineup body per conversation turn; every third turn has no lineup."""
    c = v("conversations").withColumn("fixture_id", F.col("conv_id") * 1000 + F.col("turn"))
    home, away = F.col("conv_id") % 7, F.col("conv_id") % 7 + 10

    def side(i, name):
        return F.struct(i.alias("id"), F.lit(name).alias("name"))

    def entry(i, name):
        player = F.struct(i.alias("id"), name.alias("name"), F.col("turn").cast("int").alias("number"), F.lit("G").alias("pos"))
        return F.struct(player.alias("player"))

    def lineup(i, name, coach):
        return F.struct(
            side(i, name).alias("team"), F.col("role").alias("formation"),
            F.when(coach, side(F.col("turn"), "coach")).alias("coach"),
            F.array(entry(F.col("turn") * 10 + i, F.col("text"))).alias("startXI"),
            F.when(F.col("turn") % 2 == 0, F.array(entry(F.col("turn"), F.col("role")), entry(F.col("turn") + 1, F.col("role")))).alias("substitutes"),
        )

    teams = F.array(lineup(home, "h", F.col("turn") % 2 == 1), lineup(away, "a", F.lit(True)))
    fixture = F.struct(
        F.struct(F.col("fixture_id").alias("id"), F.lit("2024-01-01T10:00:00+00:00").alias("date")).alias("fixture"),
        F.struct(side(home, "h").alias("home"), side(away, "a").alias("away")).alias("teams"),
        F.struct(F.col("turn").cast("int").alias("home")).alias("goals"),
    )
    response = F.when(F.col("turn") % 3 == 2, F.array().cast(f"array<{_type(v, teams)}>")).otherwise(teams)
    return c.select(
        "fixture_id", F.lit(1).alias("league_id"), F.lit(2024).alias("season"), F.to_json(fixture).alias("fixture_json"),
        F.to_json(F.struct(response.alias("response"))).alias("lineups_json"),
    )


def _type(v, teams) -> str:
    c = v("conversations").withColumn("fixture_id", F.lit(0).cast("long"))
    return c.select(F.element_at(teams, 1).alias("t")).schema["t"].dataType.simpleString()


_SIDES = """(select conv_id * 1000 + turn as fixture_id, turn, role, text, conv_id % 7 as home, conv_id % 7 + 10 as away
   from conversations where turn % 3 <> 2)"""


@query(
    "flatten_fixtures", "A7",
    "fixture_id:l home_team_id:l away_team_id:l team_id:l team_name:s is_home:b formation:s coach_id:l home_goals:l away_goals:l venue:s",
    f"""select fixture_id, home as home_team_id, away as away_team_id, team_id, team_name, team_id = home as is_home,
          role as formation, case when team_name = 'a' or turn % 2 = 1 then turn end as coach_id, turn as home_goals,
          null as away_goals, null as venue
        from (select *, home as team_id, 'h' as team_name from {_SIDES} union all select *, away, 'a' from {_SIDES})""",
)
def _(v):
    return nested.flatten_fixtures(_bodies(v))


@query(
    "flatten_rosters", "A8", "fixture_id:l team_id:l player_id:l player_name:s number:l is_starter:b",
    f"""with t as (select *, home as team_id from {_SIDES} union all select *, away from {_SIDES})
        select fixture_id, team_id, turn * 10 + team_id as player_id, md5(text) as player_name, turn as number, true as is_starter from t
        union all select fixture_id, team_id, turn, md5(role), turn, false from t where turn % 2 = 0
        union all select fixture_id, team_id, turn + 1, md5(role), turn, false from t where turn % 2 = 0""",
)
def _(v):
    return nested.flatten_rosters(_bodies(v)).withColumn("player_name", F.md5("player_name"))


@query(
    "flatten_statistics", "A9", "fixture_id:l team_id:l shots_on_goal:d6 ball_possession:d6 fouls:d6 red_cards:d6",
    """select fixture_id, case when team_side = 'O' then 1 else 2 end as team_id, sot as shots_on_goal,
       shots / 100.0e0 as ball_possession, null as fouls, null as red_cards from team_stats""",
)
def _(v):
    def stat(kind, value):
        return F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"))

    pairs = F.array(
        stat("Shots on Goal", F.lit("-1")), stat("Shots on Goal", F.col("sot")), stat("Fouls", F.lit("")),
        stat("Ball Possession", F.concat(F.col("shots"), F.lit("%"))), stat("Weather", F.lit("7")),
    )
    side = F.struct(
        F.struct(F.when(F.col("team_side") == "O", 1).otherwise(2).alias("id")).alias("team"), pairs.alias("statistics")
    )
    body = F.to_json(F.struct(F.array(side).alias("response")))
    return nested.flatten_statistics(v("team_stats").select("fixture_id", body.alias("statistics_json")))


@query(
    "kv_to_wide", "A9", "fixture_id:l accepted:d2 returned:d2",
    """select l_orderkey as fixture_id,
         arg_max(l_quantity, row(l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity)) filter (where l_returnflag = 'A') as accepted,
         arg_max(l_quantity, row(l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity)) filter (where l_returnflag = 'R') as returned
       from lineitem where l_returnflag in ('A', 'R') group by 1""",
)
def _(v):
    rows = v("lineitem").withColumnRenamed("l_orderkey", "fixture_id")
    position = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]
    return nested.kv_to_wide(rows, ["fixture_id"], "l_returnflag", "l_quantity", position, {"A": "accepted", "R": "returned"})


@query(
    "coerce_stats", "A10", "event_id:l stat:d6",
    """with k as (select event_id, regexp_extract(props, '[0-9]+', 0) as k from events)
       select event_id, case event_id % 5 when 0 then k::double / 100 when 1 then k::double when 4 then k::double end as stat from k""",
)
def _(v):
    k = F.regexp_extract("props", "[0-9]+", 0)
    i = F.col("event_id") % 5
    raw = F.when(i == 0, F.concat(k, F.lit("%"))).when(i == 1, k).when(i == 2, "").when(i == 3, "n/a%").otherwise(F.concat(F.lit(" "), k, F.lit(" ")))
    return v("events").select("event_id", text.coerce_stat(raw).alias("stat"))


@query(
    "flatten_rankings", "A11", "rank:l country_full:s total_points:d2 previous_points:d2 rank_change:l confederation:s rank_date:t",
    """select rnk as rank, 'TEAM ' || team as country_full, points as total_points, points - 1 as previous_points, 0 as rank_change,
       null as confederation, rank_date from rankings""",
)
def _(v):
    name = F.struct(F.concat(F.lit("TEAM "), "team").alias("Description"))
    row = F.struct(
        F.col("rnk").alias("Rank"), F.array(name, F.struct(F.lit("other").alias("Description"))).alias("TeamName"),
        F.col("points").alias("TotalPoints"), (F.col("points") - 1).alias("PrevPoints"), F.lit(0).alias("RankingMovement"),
    )
    body = F.to_json(F.struct(F.array(row).alias("Results")))
    return nested.flatten_rankings(v("rankings").select("rank_date", body.alias("body")))


@query(
    "write_and_read", "A12", "match_id:l league:s year:l",
    "select match_id, league, extract(year from date) as year from matches",
)
def _(v):
    path = f"{shared_folder(v.spark)}/processed-{uuid.uuid4().hex}"
    rows = v("matches").withColumn("year", F.year("date"))
    tables.write_table(rows, path, partition_by=["year"])
    return tables.read_table(v.spark, path, fmt="parquet", columns=["match_id", "league", "year"])


@query(
    "export_payload", "A13", "section:s team:l value:d4",
    """select 'matchups' as section, home_team as team, avg(away_score) as value from matches group by 2
       union all select 'team_summary', home_team, case when home_team <> 4 then avg(home_score) end from matches group by 2""",
)
def _(v):
    value = F.when(F.col("team") != 4, F.avg("home_score")).otherwise(F.lit(float("nan")))
    per_team = v("matches").groupBy(F.col("home_team").alias("team"))
    summary = per_team.agg(value.alias("value"))
    matchups = per_team.agg(F.avg("away_score").alias("value"))
    payload = export.export_payload({"team_summary": summary, "matchups": matchups})
    record = F.from_json("record", "team long, value double")
    return payload.select("section", record.alias("r")).select("section", "r.*")
