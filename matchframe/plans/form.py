"""Windows and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchframe.operators import careers, windows
from matchframe.plans.registry import query

LONG_SQL = """select match_id, date, 'home' as side, home_team as team, home_score as gf, away_score as ga, (home_score > away_score)::int as win,
     (home_score = away_score)::int as draw, home_score - away_score as gd from matches
   union all select match_id, date, 'away', away_team, away_score, home_score, (away_score > home_score)::int, (home_score = away_score)::int,
     away_score - home_score from matches"""
_W = "partition by team order by date, match_id, side desc"
FORM_SQL = f"""select match_id, side, team,
     least(coalesce(date_diff('day', lag(date) over ({_W}), date), 365), 365) as days_rest,
     coalesce(sum(win) over ({_W} rows between 10 preceding and 1 preceding), 0) as form_wins,
     coalesce(sum(draw) over ({_W} rows between 10 preceding and 1 preceding), 0) as form_draws,
     coalesce(sum(gd) over ({_W} rows between 10 preceding and 1 preceding), 0) as form_gd,
     count(gd) over ({_W} rows between 10 preceding and 1 preceding) as form_n from ({LONG_SQL})"""
_FORM_COLS = ["days_rest", "form_wins", "form_draws", "form_gd", "form_n"]


@query("to_long", "F1", "match_id:l side:s team:l gf:l ga:l win:l draw:l gd:l", LONG_SQL)
def _(v):
    return windows.to_long(v("matches"))


@query(
    "days_since_prev", "F2", "match_id:l team:l days_rest:l",
    f"select match_id, team, least(coalesce(date_diff('day', lag(date) over ({_W}), date), 5), 5) as days_rest from ({LONG_SQL})",
)
def _(v):
    long = windows.to_long(v("matches")).withColumn("away", (F.col("side") == "away").cast("int"))
    return windows.days_since_prev(long, ["team"], "date", ["match_id", "away"], cap=5)


@query("rolling_form", "F3", "match_id:l side:s team:l days_rest:l form_wins:l form_draws:l form_gd:l form_n:l", FORM_SQL)
def _(v):
    return windows.form_features(windows.to_long(v("matches")))


_WIDE = ", ".join(f"max({c}) filter (where side = '{s}') as {s}_{c}" for s in ("home", "away") for c in _FORM_COLS)
_WIDE_OUT = " ".join(f"{s}_{c}:l" for s in ("home", "away") for c in _FORM_COLS)


@query(
    "match_form", "F4", f"match_id:l tournament:s {_WIDE_OUT}",
    f"select m.tournament, w.* from matches m join (select match_id, {_WIDE} from ({FORM_SQL}) group by 1) w using (match_id)",
)
def _(v):
    return windows.add_form_features(v("matches"))


@query(
    "long_to_wide", "F4", "match_id:l home_gf:l away_gf:l", "select match_id, home_score as home_gf, away_score as away_gf from matches",
)
def _(v):
    return windows.to_wide(windows.to_long(v("matches")), ["gf"])


_BASE = "select o_orderkey as fixture_id, o_orderdate as date, s.team_side from orders cross join (values ('O'), ('F')) s(team_side)"
OPPONENT_SQL = f"""select b.fixture_id, b.team_side, b.date, own.sot as sot_for, own.shots as shots_for, o.sot as sot_against, o.shots as shots_against
   from ({_BASE}) b left join team_stats own on own.fixture_id = b.fixture_id and own.team_side = b.team_side
   left join team_stats o on o.fixture_id = b.fixture_id
   where b.team_side <> o.team_side or o.team_side is null"""


def _with_opponent(v):
    base = v("orders").select(
        F.col("o_orderkey").alias("fixture_id"), F.col("o_orderdate").alias("date"), F.explode(F.array(F.lit("O"), F.lit("F"))).alias("team_side")
    )
    return windows.with_opponent(base, v("team_stats"), "fixture_id", "team_side", ["sot", "shots"], ["sot", "shots"])


@query("with_opponent", "F5", "fixture_id:l team_side:s sot_for:l shots_for:l sot_against:l shots_against:l", OPPONENT_SQL)
def _(v):
    return _with_opponent(v)


# Rolling statistics per team: a fixture's sides are played by two of thirty teams.
_TEAM = "(fixture_id * 7 + case team_side when 'O' then 0 else 11 end) % 30"
_RW = "partition by team_id order by date, fixture_id, team_side"
_ROLL = f"rows between 10 preceding and 1 preceding"
ROLLING_SQL = f"""select fixture_id, team_id, n_r10, """ + ", ".join(
    f"case when c_{c} >= 3 then a_{c} end as {c}_r10" for c in ("sot_for", "sot_against", "shots_for")
) + f""" from (select fixture_id, team_id, count(sot_for) over ({_RW} {_ROLL}) as n_r10, """ + ", ".join(
    f"count({c}) over ({_RW} {_ROLL}) as c_{c}, avg({c}) over ({_RW} {_ROLL}) as a_{c}" for c in ("sot_for", "sot_against", "shots_for")
) + f" from (select *, {_TEAM} as team_id from ({OPPONENT_SQL})))"


def _rolling(v):
    team = (F.col("fixture_id") * 7 + F.when(F.col("team_side") == "O", 0).otherwise(11)) % 30
    rows = _with_opponent(v).withColumn("team_id", team)
    cols = {c: f"{c}_r10" for c in ("sot_for", "sot_against", "shots_for")}
    return windows.rolling_prior_mean(rows, ["team_id"], ["date", "fixture_id", "team_side"], cols, count_of="sot_for", count="n_r10")


@query("rolling_means", "F6", "fixture_id:l team_id:l sot_for_r10:d6 sot_against_r10:d6 shots_for_r10:d6 n_r10:l", ROLLING_SQL)
def _(v):
    return _rolling(v)


@query(
    "rolling_sums", "F3", "fixture_id:l team_side:s total:l n:l",
    """select fixture_id, team_side, coalesce(sum(sot) over w, 0) as total, count(*) over w as n from team_stats
       window w as (partition by team_side, fixture_id % 50 order by fixture_id rows between 4 preceding and 1 preceding)""",
)
def _(v):
    rows = v("team_stats").withColumn("part", F.col("fixture_id") % 50)
    return windows.rolling_prior_sum(rows, ["team_side", "part"], ["fixture_id"], {"sot": "total"}, 4, "n")


@query(
    "attached_side_features", "F7",
    "match_id:l home_sot_for_r10:d6 away_sot_for_r10:d6 diff_sot_for_r10:d6 sot_net_diff:d6",
    f"""with f as ({ROLLING_SQL}), x as (select o_orderkey as fixture_id, (o_orderkey * 7) % 30 as home_id, (o_orderkey * 7 + 11) % 30 as away_id from orders),
         e as (select x.fixture_id, h.sot_for_r10 as hf, a.sot_for_r10 as af, h.sot_against_r10 as ha, a.sot_against_r10 as aa
               from x left join f h on h.fixture_id = x.fixture_id and h.team_id = home_id left join f a on a.fixture_id = x.fixture_id and a.team_id = away_id)
       select match_id, hf as home_sot_for_r10, af as away_sot_for_r10, hf - af as diff_sot_for_r10, (hf - ha) - (af - aa) as sot_net_diff
       from matches left join e on match_id = fixture_id and match_id % 6 <> 0""",
)
def _(v):
    fixtures = v("orders").select(
        F.col("o_orderkey").alias("fixture_id"),
        F.explode(
            F.array(
                F.struct((F.col("o_orderkey") * 7 % 30).alias("team_id"), F.lit(True).alias("is_home")),
                F.struct(((F.col("o_orderkey") * 7 + 11) % 30).alias("team_id"), F.lit(False).alias("is_home")),
            )
        ).alias("_s"),
    ).select("fixture_id", "_s.*")
    bridge = v("matches").select("match_id", F.when(F.col("match_id") % 6 != 0, F.col("match_id")).alias("fixture_id"))
    return careers.attach_side_features(
        v("matches"), _rolling(v), fixtures, bridge, ["sot_for_r10", "sot_against_r10"], ["match_id"],
        net={"sot_net_diff": ("sot_for_r10", "sot_against_r10")},
    )


@query(
    "careers_to_date", "F8", "fixture_id:l coach_id:l career_matches:l career_wr:d12",
    """select fixture_id, coach_id, row_number() over w - 1 as career_matches,
         coalesce(sum(win) over (partition by coach_id order by date, fixture_id rows between unbounded preceding and 1 preceding) / nullif(row_number() over w - 1, 0), 0) as career_wr
       from coach_matches window w as (partition by coach_id order by date, fixture_id)""",
)
def _(v):
    return windows.career_to_date(v("coach_matches"), "coach_id", "date", "fixture_id")


@query(
    "tenures", "F9", "fixture_id:l tenure_days:l",
    "select fixture_id, date_diff('day', min(date) over (partition by coach_id, team_id), date) as tenure_days from coach_matches",
)
def _(v):
    return windows.tenure_days(v("coach_matches"), ["coach_id", "team_id"], "date")


_PRICED = """select *, home_win_prob - 1 / home_odds > 0.02 as placed,
   greatest(0.0, ((home_odds - 1) * home_win_prob - (1 - home_win_prob)) / (home_odds - 1)) as f from bets"""


@query(
    "flat_stakes", "F10", "bet_id:l pnl:d4 bankroll:d4 cumulative_profit:d4",
    f"""select bet_id, pnl, 1000 + sum(pnl) over w as bankroll, sum(pnl) over w as cumulative_profit
        from (select *, case when not placed then 0.0 when home_win = 1 then 10 * (home_odds - 1) else -10 end as pnl from ({_PRICED}))
        window w as (partition by account order by date, bet_id)""",
)
def _(v):
    return windows.flat_stake_pnl(v("bets"), ["account"], ["date", "bet_id"], "home_win_prob", "home_odds", "home_win", threshold=0.02)


@query(
    "kelly_bankrolls", "F11", "bet_id:l log_bankroll:d4 staked:b",
    f"""select bet_id, case when ruined > 0 then -1 else ln(1000) + lg end as log_bankroll, placed and f > 0 as staked from (
          select *, sum(case when r <= -1 then 1 else 0 end) over w as ruined, sum(case when r > -1 then ln(1 + r) else 0 end) over w as lg
          from (select *, case when not placed then 0.0 when home_win = 1 then 0.25 * f * (home_odds - 1) else -0.25 * f end as r from ({_PRICED}))
          window w as (partition by account order by date, bet_id))""",
)
def _(v):
    rows = windows.kelly_bankroll(
        v("bets"), ["account"], ["date", "bet_id"], "home_win_prob", "home_odds", "home_win", fraction=0.25, threshold=0.02
    )
    return rows.select("bet_id", F.when(F.col("bankroll") > 0, F.ln("bankroll")).otherwise(-1).alias("log_bankroll"), (F.col("pnl") != 0).alias("staked"))


@query(
    "last_matches", "F12", "team:l match_id:l recency:l",
    f"""select * from (select team, match_id, row_number() over (partition by team order by date desc, match_id desc) as recency
        from ({LONG_SQL})) where recency <= 10""",
)
def _(v):
    return windows.last_n_per_entity(v("matches"))


_LEAGUES = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified", "5-LOW": "low"}
_LEAGUE_MEANS = ", ".join(f"avg(home_score) filter (where league = '{league}') as {name}" for league, name in _LEAGUES.items())


@query(
    "mean_goals_by_league", "F14", "year:l " + " ".join(f"{name}:d6" for name in _LEAGUES.values()),
    f"select extract(year from date) as year, {_LEAGUE_MEANS} from matches group by 1",
)
def _(v):
    rows = v("matches").withColumn("year", F.year("date"))
    table = windows.pivot_metric(rows, "year", "league", "home_score", list(_LEAGUES))
    return table.select("year", *[F.col(league).alias(name) for league, name in _LEAGUES.items()])
