"""Point-in-time joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchframe.functions.dates import age_at
from matchframe.operators import asof
from matchframe.plans.registry import query


def ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


_RANKED = """select m.match_id, coalesce({s}.points, {s}f.points) as {s}_points, coalesce({s}.rnk, {s}f.rnk) as {s}_rank
   from matches m asof left join rankings {s} on m.{s}_team = {s}.team and m.date >= {s}.rank_date
   left join (select team, arg_min(points, rank_date) as points, arg_min(rnk, rank_date) as rnk from rankings group by 1) {s}f on m.{s}_team = {s}f.team"""


@query(
    "rankings_asof", "D1", "match_id:l home_points:d2 home_rank:l away_points:d2 away_rank:l",
    f"select * from ({_RANKED.format(s='home')}) join ({_RANKED.format(s='away')}) using (match_id)",
)
def _(v):
    return asof.asof_both_sides(v("matches"), v("rankings"), "team", "rank_date", {"points": "points", "rnk": "rank"})


@query(
    "values_asof", "D2", "fixture_id:l value:d4",
    """select fixture_id, v.value from appearances a asof left join market_value v on a.player_id = v.player_id and a.date >= v.date""",
)
def _(v):
    return asof.asof(
        v("appearances"), v("market_value"), ["player_id"], ["player_id"], "date", "date", {"value": "value"}, ["fixture_id"], ["event_id"]
    )


CLUB_SQL = """with t as (select * from transfers where to_team_id is not null),
     f as (select player_id, arg_min(from_team_id, event_id) filter (where from_team_id is not null) as first_from from t group by 1)
   select a.fixture_id, a.player_id, a.team, coalesce(t.to_team_id, f.first_from) as club_id
   from appearances a asof left join t on a.player_id = t.player_id and a.date >= t.transfer_date left join f on a.player_id = f.player_id"""


def clubs(v):
    known = v("transfers").filter(F.col("to_team_id").isNotNull() & F.col("transfer_date").isNotNull())
    return asof.asof(
        v("appearances"), known, ["player_id"], ["player_id"], "date", "transfer_date", {"to_team_id": "club_id"}, ["fixture_id"], ["event_id"],
        fallback="first_known", fallback_values={"club_id": "from_team_id"},
    )


@query("clubs_asof", "D3", "fixture_id:l club_id:l", CLUB_SQL)
def _(v):
    return clubs(v)


@query(
    "clubs_at_date", "D4", "player_id:l club_id:l",
    """select * from (select player_id, case when count(*) filter (where transfer_date <= timestamp '2024-01-10 00:00:00') > 0
          then arg_max_null(to_team_id, event_id) filter (where transfer_date <= timestamp '2024-01-10 00:00:00')
          else arg_min_null(from_team_id, event_id) end as club_id from transfers group by 1) where club_id is not null""",
)
def _(v):
    return asof.state_at(
        v("transfers"), ts("2024-01-10"), "player_id", "transfer_date", "to_team_id", "from_team_id", ["event_id"], "club_id"
    )


@query(
    "values_at_date", "D5", "player_id:l value:d4",
    "select player_id, arg_max(value, event_id) as value from market_value where date <= timestamp '2024-01-15 00:00:00' group by 1",
)
def _(v):
    return asof.latest_on_or_before(v("market_value"), "player_id", "date", ts("2024-01-15"), ["value"], ["event_id"])


@query(
    "active_spells", "D6", "fixture_id:l active:b",
    """select fixture_id, exists (select 1 from spells s where s.player_id = a.player_id and s.from_date <= a.date
         and s.from_date + to_hours(h) >= a.date) as active from appearances a""",
)
def _(v):
    spells = v("spells").withColumn("end_date", F.timestamp_add("HOUR", F.col("h"), F.col("from_date")))
    return asof.active_interval(v("appearances"), spells, "player_id", "date", "from_date", "end_date", ["fixture_id"])


@query(
    "month_snapshots", "D7", "entity:l snapshot:t",
    """select distinct entity, cast(date_trunc('month', date) as date) as snapshot
       from (select home_team as entity, date from matches union all select away_team, date from matches)""",
)
def _(v):
    return asof.snapshots(v("matches"), ["home_team", "away_team"], "date", "month")


@query(
    "year_snapshots", "D7", "entity:l snapshot:t",
    """select distinct entity, make_date(cast(extract(year from date) as int), 7, 1) as snapshot
       from (select home_team as entity, date from matches union all select away_team, date from matches)""",
)
def _(v):
    return asof.snapshots(v("matches"), ["home_team", "away_team"], "date", "year")


@query(
    "eligible_players", "D8", "team_id:l player_id:l snapshot:t age:d4",
    """with s as (select distinct home_team as team_id, make_date(cast(extract(year from date) as int), 7, 1) as snapshot from matches),
         p as (select distinct team_id, player_id from lineups),
         b as (select player_id, date '1950-01-01' + cast(birth_key * 400 as int) as born from profiles where player_id % 10 <> 0)
       select team_id, player_id, snapshot, date_diff('day', born, snapshot) / 365.25 as age from s join p using (team_id) join b using (player_id)
       where date_diff('day', born, snapshot) / 365.25 between 17 and 37""",
)
def _(v):
    snaps = asof.snapshots(v("matches"), ["home_team"], "date", "year").withColumnRenamed("entity", "team_id")
    return asof.eligible_at(
        snaps, v("lineups"), born(v), "team_id", "player_id", "snapshot", age_at(F.col("snapshot"), F.col("date_of_birth")), "date_of_birth"
    )


def born(v):
    """Profiles with a birth date; every tenth player has none."""
    day = F.date_add(F.lit("1950-01-01").cast("date"), F.col("birth_key") * 400)
    return v("profiles").withColumn("date_of_birth", F.when(F.col("player_id") % 10 != 0, day))


@query(
    "latest_snapshots", "D9", "team:l last_date:t score:d6",
    """with l as (select home_team as team, date, 1 as home, match_id, home_score as score from matches union all
                  select away_team, date, 0, match_id, away_score from matches),
         r as (select team, max(date) as last_date, arg_max(score, row(date, home, match_id)) as score from l group by 1)
       select n.n_nationkey + 10 as team, r.last_date, case when r.team is null then (select avg(score) from l) else score end as score
       from nation n left join r on n.n_nationkey + 10 = r.team""",
)
def _(v):
    entities = v("nation").select((F.col("n_nationkey") + 10).alias("team"))
    return asof.latest_snapshot_per_entity(v("matches"), ["score"], entities=entities)
