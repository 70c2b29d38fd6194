"""Sources, cleaning and derived columns over the match log."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchframe.functions import constants, dates, scores, text
from matchframe.operators import clean, entity
from matchframe.plans.registry import Inputs, query
from matchframe.session import small_table
from matchframe.sources import tables


def _in_list(labels) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in labels)


# Stand-in memberships: team number to strength, others get the default.
_STRENGTHS = "select team, strength from (values (1, 0.9e0), (2, 0.55e0), (3, 0.5e0), (7, 0.45e0), (12, 0.3e0), (20, 0.5e0)) s(team, strength)"


def members(v: Inputs):
    rows = [(1, 0.9), (2, 0.55), (3, 0.5), (7, 0.45), (12, 0.3), (20, 0.5)]
    return small_table(v.spark, rows, "team int, strength double")


STRENGTHS_SQL = _STRENGTHS

EVENT_WEIGHT_SQL = """case when contains(coalesce(tournament, ''), 'FIFA World Cup')
      and not contains(lower(coalesce(tournament, '')), 'qualification') then 2.0
    when {major} then 1.5
    when contains(lower(coalesce(tournament, '')), 'qualification')
      or contains(lower(coalesce(tournament, '')), 'qualifier') then 1.0
    else 0.75 end""".format(
    major=" or ".join(f"contains(coalesce(tournament, ''), '{m}')" for m in constants.MAJOR_EVENTS)
)
MARGIN_SQL = """case when abs(home_score - away_score) <= 1 then 1.0 when abs(home_score - away_score) = 2 then 1.5
    else 1.75 + (abs(home_score - away_score) - 3) / 8.0 end"""


@query(
    "scan_columns", "A1", "l_orderkey:l l_quantity:d2 l_shipdate:t",
    "select l_orderkey, l_quantity, l_shipdate from lineitem where l_shipdate >= timestamp '1998-01-01 00:00:00'",
)
def _(v):
    df = tables.read_table(v.spark, f"{v.folder}/lineitem.parquet", columns=["l_orderkey", "l_quantity", "l_shipdate"])
    return df.filter(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))


@query(
    "coerce_dates", "A2", "match_id:l day:t",
    """select o_orderkey as match_id,
       try_cast(case when o_orderkey % 7 = 0 then 'n/a' when o_orderkey % 7 = 1 then null
                     else strftime(o_orderdate, '%Y-%m-%d') end as date) as day from orders""",
)
def _(v):
    raw = F.when(F.col("o_orderkey") % 7 == 0, "n/a").when(F.col("o_orderkey") % 7 == 1, None).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd")
    )
    return v("orders").select(F.col("o_orderkey").alias("match_id"), dates.coerce_date(raw).alias("day"))


@query(
    "utc_days", "A3", "fixture_id:l day:t micros:l",
    """select event_id as fixture_id, cast(ts - interval 5 hour as date) as day, epoch_us(ts - interval 5 hour) as micros
       from events""",
)
def _(v):
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+05:00"))
    naive = dates.utc_to_naive(iso)
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return v("events").select(
        F.col("event_id").alias("fixture_id"), dates.day(naive).alias("day"),
        F.timestamp_diff("MICROSECOND", epoch, naive).alias("micros"),
    )


@query(
    "union_latest", "A4", "team:l rank_date:t points:d2",
    """select team, rank_date, points from (
         select *, row_number() over (partition by team, rank_date order by src) as rn from (
           select team, cast(rank_date as date) as rank_date, points, 0 as src from rankings where rank_date < timestamp '1999-01-01 00:00:00'
           union all
           select team, cast(rank_date as date), points + 1, 1 from rankings where rank_date >= timestamp '1998-06-01 00:00:00') u) w
       where rn = 1""",
)
def _(v):
    rows = v("rankings").select("team", F.to_date("rank_date").alias("rank_date"), "points")
    base = rows.filter(F.col("rank_date") < "1999-01-01")
    extra = rows.filter(F.col("rank_date") >= "1998-06-01").withColumn("points", F.col("points") + 1)
    return tables.union_latest(base, extra, ["team", "rank_date"], ["points"])


@query(
    "incremental_after", "A5", "match_id:l date:t",
    """select match_id, date from matches
       where date > (select max(date) from matches where date < timestamp '1999-03-01 00:00:00')""",
)
def _(v):
    rows = v("matches").select("match_id", "date")
    held = rows.filter(F.col("date") < F.lit("1999-03-01").cast("timestamp_ntz"))
    return tables.incremental_after(rows, held, "date")


@query(
    "pending_fixtures", "A6", "fixture_id:l",
    "select o_orderkey as fixture_id from orders where o_orderkey not in (select l_orderkey from lineitem)",
)
def _(v):
    work = v("orders").select(F.col("o_orderkey").alias("fixture_id"))
    return tables.pending(work, v("lineitem").select(F.col("l_orderkey").alias("fixture_id")), ["fixture_id"])


@query(
    "resume_progress", "A6", "total:l already_done:l to_do:l",
    """select count(*) as total, count(d) as already_done, count(*) - count(d) as to_do
       from orders left join (select distinct l_orderkey as d from lineitem) on o_orderkey = d""",
)
def _(v):
    work = v("orders").select(F.col("o_orderkey").alias("fixture_id"))
    return tables.resume_progress(work, v("lineitem").select(F.col("l_orderkey").alias("fixture_id")), ["fixture_id"])


@query(
    "column_coverage", "A14", "name:s share:d6",
    """unpivot (select avg((from_team_id is not null)::int) as from_team_id, avg((to_team_id is not null)::int) as to_team_id,
                avg((player_id is not null)::int) as player_id from transfers)
       on from_team_id, to_team_id, player_id into name "name" value share""",
)
def _(v):
    return tables.coverage(v("transfers"), ["from_team_id", "to_team_id", "player_id"])


@query(
    "league_scope", "A15", "league_id:l season:l fixture_id:l",
    """with l as (select n_nationkey as league_id, n_regionkey from nation where n_nationkey in (1, 4, 5, 6, 7, 9, 22))
       select league_id, cast(extract(year from o_orderdate) as int) as season, o_orderkey as fixture_id
       from orders join customer on o_custkey = c_custkey join l on c_nationkey = league_id
       where extract(year from o_orderdate) between 1995 + n_regionkey and 1998 + n_regionkey""",
)
def _(v):
    leagues = v("nation").select(
        F.col("n_nationkey").alias("league_id"),
        F.sequence(F.col("n_regionkey") + 1995, F.col("n_regionkey") + 1998).alias("seasons"),
    )
    fixtures = v("orders").join(v("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("league_id"), F.year("o_orderdate").alias("season"), F.col("o_orderkey").alias("fixture_id")
    )
    return tables.scope(leagues, fixtures)


@query(
    "competitive_matches", "B1", "match_id:l tournament:s",
    f"""select match_id, tournament from matches
        where tournament is null or tournament not in ({_in_list(constants.FRIENDLY_LABELS)})""",
)
def _(v):
    return clean.exclude_labels(v("matches")).select("match_id", "tournament")


@query(
    "load_matches", "B2", "match_id:l home:s away:s",
    """with named as (select match_id, date, 'NATION_' || home_team as home, 'NATION_' || away_team as away,
           case when match_id % 13 = 0 then null else home_score end as home_score, away_score from matches),
         f as (select * from (select *, row_number() over (partition by former order by ord desc) as rn from former_names) where rn = 1)
       select match_id, case when date between h.start_date and h.end_date then h.current_name else home end as home,
              case when date between a.start_date and a.end_date then a.current_name else away end as away
       from named left join f h on home = h.former left join f a on away = a.former
       where extract(year from date) >= 1998 and home_score is not null and away_score is not null""",
)
def _(v):
    raw = v("matches").select(
        "match_id", "date", F.concat(F.lit("NATION_"), "home_team").alias("home_team"),
        F.concat(F.lit("NATION_"), "away_team").alias("away_team"),
        F.when(F.col("match_id") % 13 != 0, F.col("home_score")).alias("home_score"), "away_score",
    )
    names = v("former_names").withColumnRenamed("current_name", "current")
    loaded = clean.load_matches(raw, 1998, names)
    return loaded.select("match_id", F.col("home_team").alias("home"), F.col("away_team").alias("away"))


@query(
    "contains_filter", "B3", "match_id:l",
    "select match_id from matches where contains(tournament, 'World')",
)
def _(v):
    return v("matches").filter(text.contains_or_false(F.col("tournament"), "World")).select("match_id")


@query(
    "outcomes", "B4", "match_id:l outcome:l",
    """select match_id, case when home_score > away_score then 2 when home_score = away_score then 1 else 0 end as outcome
       from matches""",
)
def _(v):
    return v("matches").select("match_id", scores.outcome(F.col("home_score"), F.col("away_score")).alias("outcome"))


@query("home_wins", "B5", "match_id:l home_win:l", "select match_id, (home_score > away_score)::int as home_win from matches")
def _(v):
    return v("matches").select("match_id", scores.home_win(F.col("home_score"), F.col("away_score")).alias("home_win"))


@query("event_weights", "B6", "match_id:l weight:d4", f"select match_id, {EVENT_WEIGHT_SQL} as weight from matches")
def _(v):
    return v("matches").select("match_id", scores.event_weight(F.col("tournament")).alias("weight"))


@query("margin_multipliers", "B7", "match_id:l margin:d6", f"select match_id, {MARGIN_SQL} as margin from matches")
def _(v):
    return v("matches").select("match_id", scores.margin_multiplier(F.col("home_score") - F.col("away_score")).alias("margin"))


@query(
    "group_strengths", "B8", "match_id:l strength:d6",
    f"select match_id, coalesce(strength, 1.0) as strength from matches left join ({_STRENGTHS}) on home_team = team",
)
def _(v):
    return clean.group_strength(v("matches"), "home_team", "strength", members(v)).select("match_id", "strength")


K_SQL = f"""select m.*, 32.0 * least(({EVENT_WEIGHT_SQL}) * ({MARGIN_SQL}), 2.0)
    * ((coalesce(h.strength, 1.0) + coalesce(a.strength, 1.0)) / 2) as k
    from matches m left join ({_STRENGTHS}) h on m.home_team = h.team left join ({_STRENGTHS}) a on m.away_team = a.team"""


@query("adjusted_k", "B9", "match_id:l k:d6", f"select match_id, k from ({K_SQL})")
def _(v):
    both = clean.group_strength(clean.group_strength(v("matches"), "home_team", "sh", members(v)), "away_team", "sa", members(v))
    gd = F.col("home_score") - F.col("away_score")
    return both.select("match_id", scores.k_adjusted(F.col("tournament"), gd, F.col("sh"), F.col("sa")).alias("k"))


# Two synthetic ratings per match, so that rating arithmetic has inputs.
_RATED = "select *, 1400.0 + home_team * 8 as home_elo_pre, 1400.0 + away_team * 8 as away_elo_pre from matches"


def rated(v: Inputs):
    return v("matches").withColumns(
        {"home_elo_pre": F.col("home_team") * 8 + 1400.0, "away_elo_pre": F.col("away_team") * 8 + 1400.0}
    )


@query(
    "expected_scores", "B10", "match_id:l p:d6",
    f"select match_id, 1 / (1 + pow(10.0, (away_elo_pre - home_elo_pre) / 400)) as p from ({_RATED})",
)
def _(v):
    return rated(v).select("match_id", scores.expected_score(F.col("home_elo_pre"), F.col("away_elo_pre")).alias("p"))


@query(
    "effective_diffs", "B11", "match_id:l diff:d6",
    f"""select match_id, (home_elo_pre + case when coalesce(neutral, false) then 0 else 100 end - away_elo_pre) / 400 as diff
        from ({_RATED})""",
)
def _(v):
    diff = scores.effective_diff(F.col("home_elo_pre"), F.col("away_elo_pre"), F.col("neutral")) / 400
    return rated(v).select("match_id", diff.alias("diff"))


@query(
    "expected_goals", "B12", "match_id:l goals:d6",
    f"""select match_id, exp(greatest(least(0.336 + (home_elo_pre * 4 - away_elo_pre * 4) / 200.0
            + case when coalesce(neutral, false) then 0.0 else 0.25 end, 3.0), -3.0)) as goals from ({_RATED})""",
)
def _(v):
    bonus = F.when(F.coalesce(F.col("neutral"), F.lit(False)), 0.0).otherwise(0.25)
    value = scores.expected_goals(F.col("home_elo_pre") * 4, F.col("away_elo_pre") * 4, bonus)
    return rated(v).select("match_id", value.alias("goals"))


@query(
    "signed_roots", "B13", "match_id:l root:d6",
    "select match_id, sign(home_score - away_score - 0.3) * sqrt(abs(home_score - away_score - 0.3)) as root from matches",
)
def _(v):
    x = F.col("home_score") - F.col("away_score") - F.lit(0.3)
    return v("matches").select("match_id", scores.signed_sqrt(x).alias("root"))


_FEATURED = """select match_id, neutral, 1400.0 + home_team * 8 as home_elo_pre, 1400.0 + away_team * 8 as away_elo_pre,
   case when home_team = 3 then null else home_team * 90000.0 end as home_top_n_value, away_team * 90000.0 as away_top_n_value,
   24 + home_team / 10.0e0 as home_outfield_mean_age, 24 + away_team / 10.0e0 as away_outfield_mean_age,
   0.1 + home_score / 10.0e0 as home_top1_share, 0.1 + away_score / 10.0e0 as away_top1_share,
   case when home_score = 0 then null else home_score / 20.0e0 end as home_injured_value_share,
   away_score / 20.0e0 as away_injured_value_share,
   case when home_score > 2 then 1 end as home_injured_top1, case when away_score > 2 then 1 else 0 end as away_injured_top1,
   home_score / 30.0e0 as home_injured_top3_share, case when away_score > 0 then away_score / 30.0e0 end as away_injured_top3_share,
   case when match_id % 5 = 0 then null else 1000 + home_team * 10 end as home_points, 1000 + away_team * 10 as away_points
 from matches"""
_FLOORED = "greatest({0}_top_n_value, 100000.0)"


def featured(v: Inputs):
    return v("matches").selectExpr(
        "match_id", "neutral", "1400D + home_team * 8 as home_elo_pre", "1400D + away_team * 8 as away_elo_pre",
        "if(home_team = 3, null, home_team * 90000D) as home_top_n_value", "away_team * 90000D as away_top_n_value",
        "24 + home_team / 10D as home_outfield_mean_age", "24 + away_team / 10D as away_outfield_mean_age",
        "0.1D + home_score / 10D as home_top1_share", "0.1D + away_score / 10D as away_top1_share",
        "if(home_score = 0, null, home_score / 20D) as home_injured_value_share", "away_score / 20D as away_injured_value_share",
        "if(home_score > 2, 1, null) as home_injured_top1", "if(away_score > 2, 1, 0) as away_injured_top1",
        "home_score / 30D as home_injured_top3_share", "if(away_score > 0, away_score / 30D, null) as away_injured_top3_share",
        "if(match_id % 5 = 0, null, 1000 + home_team * 10) as home_points", "1000 + away_team * 10 as away_points",
    )


@query(
    "diff_features", "B14",
    "match_id:l elo_diff_norm:d6 log_value_diff:d6 outfield_age_diff:d6 top1_share_diff:d6 injury_share_diff:d6 "
    "injured_top1_diff:d6 injured_top3_diff:d6 points_diff:d6",
    f"""select match_id,
        (home_elo_pre + case when coalesce(neutral, false) then 0 else 100 end - away_elo_pre) / 400 as elo_diff_norm,
        case when home_top_n_value is not null then log10({_FLOORED.format("home")} / {_FLOORED.format("away")}) end as log_value_diff,
        home_outfield_mean_age - away_outfield_mean_age as outfield_age_diff, home_top1_share - away_top1_share as top1_share_diff,
        coalesce(home_injured_value_share, 0) - coalesce(away_injured_value_share, 0) as injury_share_diff,
        coalesce(home_injured_top1, 0) - coalesce(away_injured_top1, 0) as injured_top1_diff,
        coalesce(home_injured_top3_share, 0) - coalesce(away_injured_top3_share, 0) as injured_top3_diff,
        (coalesce(home_points, 0) - coalesce(away_points, 0)) / 1000.0e0 as points_diff from ({_FEATURED})""",
)
def _(v):
    return clean.diff_features(featured(v))


@query(
    "side_features", "B15", "match_id:l home_elo:d6 away_elo:d6 home_logv:d6 away_logv:d6 home_fpts:d6 away_fpts:d6",
    f"""select match_id, home_elo_pre / 100 as home_elo, away_elo_pre / 100 as away_elo,
        case when home_top_n_value is not null then log10({_FLOORED.format("home")}) end as home_logv,
        log10({_FLOORED.format("away")}) as away_logv,
        coalesce(home_points, 0) / 1000.0e0 as home_fpts, coalesce(away_points, 0) / 1000.0e0 as away_fpts from ({_FEATURED})""",
)
def _(v):
    return clean.side_features(featured(v))


@query(
    "cross_features", "B16", "match_id:l attack_vs_def_h:d6 attack_vs_def_a:d6 expected_goal_diff:d6",
    """select match_id, (1500 + home_team - (1480 + away_score)) / 200.0e0 as attack_vs_def_h,
       (1500 + away_team - (1490 + home_score)) / 200.0e0 as attack_vs_def_a,
       (1.1e0 + home_score / 10.0e0) - (0.9e0 + away_score / 10.0e0) as expected_goal_diff from matches""",
)
def _(v):
    rows = v("matches").selectExpr(
        "match_id", "1500D + home_team as home_attack_pre", "1480D + away_score as away_defense_pre",
        "1500D + away_team as away_attack_pre", "1490D + home_score as home_defense_pre",
        "1.1D + home_score / 10D as exp_home_goals", "0.9D + away_score / 10D as exp_away_goals",
    )
    return clean.cross_features(rows)


@query(
    "market_view", "B17", "bet_id:l implied:d6 overround:d6 edge:d6",
    """select bet_id, 1 / home_odds as implied, 1 / home_odds + 1 / (home_odds + 0.5) + 1 / (home_odds + 1.5) as overround,
       home_win_prob - 1 / home_odds as edge from bets""",
)
def _(v):
    odds = F.col("home_odds")
    return v("bets").select(
        "bet_id", scores.implied_prob(odds).alias("implied"), scores.overround(odds, odds + 0.5, odds + 1.5).alias("overround"),
        scores.edge(F.col("home_win_prob"), odds).alias("edge"),
    )


@query(
    "top_edges", "B17", "bet_id:l edge:d6",
    "select bet_id, home_win_prob - 1 / home_odds as edge from bets order by round(home_win_prob - 1 / home_odds, 9) desc, bet_id limit 20",
)
def _(v):
    edge = F.round(scores.edge(F.col("home_win_prob"), F.col("home_odds")), 9).alias("edge")
    return v("bets").select("bet_id", edge).orderBy(F.desc("edge"), "bet_id").limit(20)


@query(
    "kelly_fractions", "B18", "bet_id:l f:d6",
    """select bet_id, greatest(0.0, ((home_odds - 1) * home_win_prob - (1 - home_win_prob)) / (home_odds - 1)) as f from bets""",
)
def _(v):
    return v("bets").select("bet_id", scores.kelly_fraction(F.col("home_win_prob"), F.col("home_odds")).alias("f"))


@query(
    "fill_mean_require_floor", "B19", "event_id:l from_filled:d6",
    """select event_id, coalesce(from_team_id, (select avg(from_team_id) from transfers where event_id < 5000)) as from_filled
       from transfers where to_team_id is not null and to_team_id > 3""",
)
def _(v):
    rows = v("transfers").withColumn("from_filled", F.col("from_team_id").cast("double"))
    train = rows.filter(F.col("event_id") < 5000)
    kept = clean.floor_filter(clean.require(rows, ["to_team_id"]), ["to_team_id"], 3)
    return clean.fill(kept, ["from_filled"], "mean", train)


@query(
    "fill_zero", "B19", "event_id:l from_team_id:l",
    "select event_id, coalesce(from_team_id, 0) as from_team_id from transfers",
)
def _(v):
    return clean.fill(v("transfers"), ["from_team_id"], "zero")


@query(
    "decay_weights", "B20", "match_id:l w:d6",
    "select match_id, exp(-0.0018 * date_diff('day', date, (select max(date) from matches))) as w from matches",
)
def _(v):
    rows = v("matches")
    return rows.select("match_id", dates.decay_weight(F.col("date"), rows.select(F.max("date")).scalar(), 0.0018).alias("w"))


@query(
    "ages", "B21", "event_id:l age:d6",
    """select event_id, floor((epoch_us(ts) - epoch_us(timestamp '1996-05-05 12:00:00' + to_days(cast(user_id as int)))) / 86400000000.0) / 365.25 as age
       from events""",
)
def _(v):
    born = F.timestamp_add("DAY", F.col("user_id").cast("int"), F.lit("1996-05-05 12:00:00").cast("timestamp_ntz"))
    return v("events").select("event_id", dates.age_at(F.col("ts"), born).alias("age"))


@query(
    "role_flags", "B22", "player_id:l is_gk:b",
    """select player_id, case when player_id % 4 = 0 then 'G' when player_id % 4 = 1 then 'M' end = 'G' is true
        or contains(lower(position), 'small') as is_gk from profiles""",
)
def _(v):
    pos = F.when(F.col("player_id") % 4 == 0, "G").when(F.col("player_id") % 4 == 1, "M")
    rows = v("profiles").withColumn("pos", pos).withColumn("profile", F.regexp_replace("position", "SMALL", "Goalkeeper"))
    return rows.select("player_id", clean.role_flag("pos", "profile").alias("is_gk"))


@query(
    "newcomer_diffs", "B23", "match_id:l diff:l",
    """select match_id, case when coalesce(h + a > 0, false) or coalesce(tournament = 'FIFA World Cup', false)
          then coalesce((h = 0)::int, 0) - coalesce((a = 0)::int, 0) else 0 end as diff
       from (select *, case when match_id % 3 = 0 then null else home_score end as h, away_score as a from matches)""",
)
def _(v):
    rows = v("matches").withColumns({"h": F.when(F.col("match_id") % 3 != 0, F.col("home_score")), "a": F.col("away_score")})
    return rows.select("match_id", clean.newcomer_diff("h", "a").alias("diff"))


@query(
    "min_support", "B24", "fixture_id:l n_matched:l",
    "select fixture_id, count(*) as n_matched from lineups where is_starter group by 1 having count(*) >= 6",
)
def _(v):
    counted = v("lineups").filter("is_starter").groupBy("fixture_id").agg(F.count(F.lit(1)).alias("n_matched"))
    return clean.min_support(counted, "n_matched", 6)
