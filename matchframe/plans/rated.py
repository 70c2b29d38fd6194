"""Sequential ratings. The SQL twin is a recursive fold, one match per step and league, with the ratings in a list."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchframe.operators import ratings, windows
from matchframe.plans.matchlog import EVENT_WEIGHT_SQL, K_SQL, STRENGTHS_SQL, members
from matchframe.plans.registry import query
from matchframe.session import durable

_ORDERED = """select *, row_number() over (partition by league order by date, match_id) as rn, cast(extract(year from date) as int) as year,
   coalesce(neutral, false) as flat from ({})"""

# One row per (league, match): ratings before (own, other) and after (r), in match order.
FOLD_SQL = f"""(with recursive o as ({_ORDERED.format(K_SQL)}),
   fold as (
     select distinct league, 0::bigint as rn, 0::bigint as match_id, 99999 as year, [1500.0::double for x in range(25)] as r, 0.0::double as own, 0.0::double as other,
       0.0::double as chance, 0.0::double as k from o
     union all
     select league, rn, match_id, year,
       list_transform(b, lambda x, i: case when i - 1 = home_team then own + k * (won - chance)
           when i - 1 = away_team then other + k * ((1 - won) - (1 - chance)) else x end) as r, own, other, chance, k
     from (select *, 1 / (1 + pow(10.0::double, (other - (own + case when flat then 0 else 100 end)) / 400)) as chance from (
       select *, b[home_team + 1] as own, b[away_team + 1] as other from (
         select o.league, o.rn, o.match_id, o.year, o.home_team, o.away_team, o.flat, o.k::double as k,
           case when home_score > away_score then 1.0::double when home_score = away_score then 0.5 else 0.0 end as won,
           case when o.year > fold.year then list_transform(fold.r, lambda x: 1500 + (1 - 0.1::double) * (x - 1500)) else fold.r end as b
         from fold join o on o.league = fold.league and o.rn = fold.rn + 1)))
   ) select * from fold where rn > 0)"""

_GOAL_K = f"""select m.*, 6.0 * least({EVENT_WEIGHT_SQL}, 2.0) * ((coalesce(h.strength, 1.0) + coalesce(a.strength, 1.0)) / 2) as k
    from matches m left join ({STRENGTHS_SQL}) h on m.home_team = h.team left join ({STRENGTHS_SQL}) a on m.away_team = a.team"""
_ROOT = "sign({0}) * sqrt(abs({0}))"
GOAL_FOLD_SQL = f"""(with recursive o as ({_ORDERED.format(_GOAL_K)}),
   fold as (
     select distinct league, 0::bigint as rn, 0::bigint as match_id, 99999 as year, [1500.0::double for x in range(25)] as a, [1500.0::double for x in range(25)] as d,
       0.0::double as ha, 0.0::double as hd, 0.0::double as aa, 0.0::double as ad, 0.0::double as lh, 0.0::double as la from o
     union all
     select league, rn, match_id, year,
       list_transform(ba, lambda x, i: case when i - 1 = home_team then ha + k * rh when i - 1 = away_team then aa + k * ra else x end) as a,
       list_transform(bd, lambda x, i: case when i - 1 = away_team then ad - k * rh when i - 1 = home_team then hd - k * ra else x end) as d,
       ha, hd, aa, ad, lh, la
     from (select *, {_ROOT.format('(home_score - lh)')} as rh, {_ROOT.format('(away_score - la)')} as ra from (
       select *, exp(greatest(least(0.336::double + (ha - ad) / 200 + case when flat then 0.0::double else 0.25 end, 3.0), -3.0)) as lh,
         exp(greatest(least(0.336::double + (aa - hd) / 200 + 0.0::double, 3.0), -3.0)) as la from (
       select *, ba[home_team + 1] as ha, bd[home_team + 1] as hd, ba[away_team + 1] as aa, bd[away_team + 1] as ad from (
         select o.league, o.rn, o.match_id, o.year, o.home_team, o.away_team, o.flat, o.k::double as k, home_score, away_score,
           case when o.year > fold.year then list_transform(fold.a, lambda x: 1500 + (1 - 0.1::double) * (x - 1500)) else fold.a end as ba,
           case when o.year > fold.year then list_transform(fold.d, lambda x: 1500 + (1 - 0.1::double) * (x - 1500)) else fold.d end as bd
         from fold join o on o.league = fold.league and o.rn = fold.rn + 1))))
   ) select * from fold where rn > 0)"""

# Ratings after the last match of each (league, year).
STATES_SQL = f"""(select league as key, year, unnest(range(25)) as team, unnest(r) as r0 from (
   select *, row_number() over (partition by league, year order by rn desc) as last from {FOLD_SQL}) where last = 1)"""


@query(
    "elo_ratings", "G1", "match_id:l key:s home_elo_pre:d4 away_elo_pre:d4 home_win_prob:d6 k_adjusted:d4",
    f"select match_id, league as key, own as home_elo_pre, other as away_elo_pre, chance as home_win_prob, k as k_adjusted from {FOLD_SQL}",
)
def _(v):
    return ratings.elo_fold(v("matches"), members=members(v))


@query(
    "regressed_ratings", "G2", "key:s team:l r0:d4",
    f"select key, team, 1500 + 0.9 * (r0 - 1500) as r0 from {STATES_SQL} where year = 2001",
)
def _(v):
    states = ratings.elo_states(v("matches"), members=members(v))
    return ratings.regress_to_mean(ratings.last_state(states))


@query("current_ratings", "G3", "key:s team:l elo:d4", f"select key, team, r0 as elo from {STATES_SQL} where year = 2001")
def _(v):
    return ratings.current_ratings(ratings.elo_states(v("matches"), members=members(v)))


@query(
    "attack_defense_ratings", "G4",
    "match_id:l home_attack_pre:d4 home_defense_pre:d4 away_attack_pre:d4 away_defense_pre:d4 exp_home_goals:d4 exp_away_goals:d4",
    f"""select match_id, ha as home_attack_pre, hd as home_defense_pre, aa as away_attack_pre, ad as away_defense_pre, lh as exp_home_goals,
        la as exp_away_goals from {GOAL_FOLD_SQL}""",
)
def _(v):
    return ratings.attack_defense_fold(v("matches"), members=members(v))


_FINAL = f"""(select league as key, unnest(range(25)) as team, unnest(a) as attack, unnest(d) as defense from (
   select *, row_number() over (partition by league order by rn desc) as last from {GOAL_FOLD_SQL}) where last = 1)"""


@query(
    "attack_defense_table", "G5", "key:s team:l attack:d4 defense:d4 total:d4",
    f"select *, attack + defense as total from {_FINAL}",
)
def _(v):
    return ratings.current_ratings(ratings.attack_defense_states(v("matches"), members=members(v)))


@query(
    "attack_defense_predictions", "G5", "match_id:l lam_home:d4 lam_away:d4",
    f"""with f as {_FINAL} select match_id,
          exp(greatest(least(0.336 + (h.attack - a.defense) / 200 + case when coalesce(neutral, false) then 0 else 0.25 end, 3), -3)) as lam_home,
          exp(greatest(least(0.336 + (a.attack - h.defense) / 200, 3), -3)) as lam_away
        from matches join f h on h.key = league and h.team = home_team join f a on a.key = league and a.team = away_team""",
)
def _(v):
    table = durable(ratings.current_ratings(ratings.attack_defense_states(v("matches"), members=members(v))))
    return ratings.attack_defense_predict(v("matches"), table, key="league")


@query(
    "resumed_ratings", "G6", "match_id:l home_elo_pre:d4 away_elo_pre:d4",
    f"select match_id, own as home_elo_pre, other as away_elo_pre from {FOLD_SQL} where year >= 1998",
)
def _(v):
    early, late = v("matches").filter("year(date) < 1998"), v("matches").filter("year(date) >= 1998")
    held = ratings.last_state(ratings.elo_states(early, members=members(v)))
    return ratings.elo_fold(late, members=members(v), state=held)


@query(
    "ratings_in_periods", "G6", "match_id:l home_elo_pre:d4 away_elo_pre:d4",
    f"select match_id, own as home_elo_pre, other as away_elo_pre from {FOLD_SQL}",
)
def _(v):
    return ratings.fold_in_periods(v("matches"), [1997, 2000], members=members(v))[0]


@query(
    "rating_histories", "F13", "match_id:l team:l elo:d4",
    f"""select * from (select match_id, home_team as team, own as elo from {FOLD_SQL} join matches using (match_id)
        union all select match_id, away_team, other from {FOLD_SQL} join matches using (match_id)) where team in (3, 7, 11)""",
)
def _(v):
    matches = v("matches")
    rated = matches.join(ratings.elo_fold(matches, members=members(v)).drop("year"), "match_id")
    return windows.rating_history(rated, [3, 7, 11])
