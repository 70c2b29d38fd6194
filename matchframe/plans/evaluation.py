"""Walk-forward folds, metrics, tournament tables, profiles and viewer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchframe.functions.constants import KNOCKOUT_48, LATER_ROUNDS_48, TOP_EVENT
from matchframe.operators import evaluate, goals, matchups, profile, ratings, standings
from matchframe.plans.goalmodels import GRID_SQL, LL_SQL, labelled, matchup_table
from matchframe.plans.matchlog import members
from matchframe.plans.rated import STATES_SQL
from matchframe.plans.registry import query

YEARS = [1997, 1998, 1999, 2000, 2001]
# Decay a day: half-lives of about half a year to ten years.
RATES = [0.0038, 0.0019, 0.00095, 0.00038, 0.00019]
_PICK = "case when {0} >= {1} and {0} >= {2} then 0 when {1} >= {2} then 1 else 2 end"
_TRUTH = "case when home_score > away_score then 2 when home_score = away_score then 1 else 0 end"

WALK_SQL = f"""with st as {STATES_SQL}, t as (select m.*, cast(extract(year from date) as int) as fold, coalesce(neutral, true) as flat from matches m
     where tournament = '{TOP_EVENT}' and extract(year from date) between 1997 and 2001)
   select match_id, fold, h.r0 as home_elo, a.r0 as away_elo,
     1 / (1 + pow(10.0, (a.r0 - (h.r0 + case when flat then 0 else 100 end)) / 400)) as home_win_prob, (home_score > away_score)::int as home_win, {_TRUTH} as outcome
   from t join st h on h.key = league and h.year = fold - 1 and h.team = home_team join st a on a.key = league and a.year = fold - 1 and a.team = away_team"""


def _walk(v):
    return evaluate.walk_forward_ratings(v("matches"), YEARS, members=members(v))


@query("walk_forward_ratings", "I1", "match_id:l fold:l home_elo:d4 away_elo:d4 home_win_prob:d6 home_win:l outcome:l", WALK_SQL)
def _(v):
    return _walk(v)


@query("walk_forward_draw", "I1", "match_id:l fold:l p_away:d3 p_draw:d3 p_home:d3 outcome:l")
def _(v):
    matches = v("matches")
    rated = ratings.elo_fold(matches, members=members(v))
    return evaluate.walk_forward_draw(matches, rated, YEARS, members=members(v), neutral_default=True)


@query("walk_forward_goals", "I1", "match_id:l fold:l rate:d5 p_away:d3 p_draw:d3 p_home:d3 outcome:l")
def _(v):
    return evaluate.walk_forward_goals(v("matches"), YEARS, [0.0018])


@query(
    "fold_sums", "I1", "fit:s home:l away:l cell:s w:d6 wh:d6 wa:d6",
    f"""with f as (select * from (values {", ".join(f"({y}, {xi!r}::double, '{y}|{xi!r}')" for y in YEARS for xi in RATES)}) t(y, xi, fit))
        select fit, home_team as home, away_team as away,
          case when home_score <= 1 and away_score <= 1 then home_score || '' || away_score else '' end as cell,
          sum(exp(-xi * date_diff('day', date, make_timestamp(y, 1, 1, 0, 0, 0)))) as w,
          sum(home_score * exp(-xi * date_diff('day', date, make_timestamp(y, 1, 1, 0, 0, 0)))) as wh,
          sum(away_score * exp(-xi * date_diff('day', date, make_timestamp(y, 1, 1, 0, 0, 0)))) as wa
        from matches join f on extract(year from date) < y group by 1, 2, 3, 4""",
)
def _(v):
    return evaluate.fold_sums(v("matches"), YEARS, RATES)


@query(
    "binary_scores", "I2", "fold:l n:l log_loss:d6 accuracy:d6",
    f"""select fold, count(*) as n, avg(case when home_win = 1 then -ln(least(greatest(home_win_prob, 1e-6), 1 - 1e-6)) else -ln(1 - least(greatest(home_win_prob, 1e-6), 1 - 1e-6)) end) as log_loss,
          avg((round_even(home_win_prob, 0) = home_win)::int) as accuracy from ({WALK_SQL}) group by 1""",
)
def _(v):
    return evaluate.score_binary(_walk(v), ["fold"])


_LL = LL_SQL.format("p_away", "p_draw", "p_home")
_HIT = f"({_PICK.format('p_away', 'p_draw', 'p_home')} = outcome)::int"
_BRIER = "pow(p_away - (outcome = 0)::int, 2) + pow(p_draw - (outcome = 1)::int, 2) + pow(p_home - (outcome = 2)::int, 2)"


@query(
    "three_way_scores", "I3", "yr:l model:l n:l log_loss:d6", f"select yr, model, count(*) as n, avg({_LL}) as log_loss from predictions group by 1, 2",
)
def _(v):
    return evaluate.score3(v("predictions"), ["yr", "model"])


@query("three_way_accuracy", "I4", "yr:l model:l accuracy:d6", f"select yr, model, avg({_HIT}) as accuracy from predictions group by 1, 2")
def _(v):
    return evaluate.score3(v("predictions"), ["yr", "model"])


@query("brier_scores", "I5", "yr:l model:l brier:d6", f"select yr, model, avg({_BRIER}) as brier from predictions group by 1, 2")
def _(v):
    return evaluate.score3(v("predictions"), ["yr", "model"])


def _bins_sql(p: str, y: str, edges, lowest: bool, source: str) -> str:
    cases = " ".join(
        f"when {p} {'>=' if lowest and i == 0 else '>'} {lo} and {p} <= {hi} then {i}" for i, (lo, hi) in enumerate(zip(edges, edges[1:]))
    )
    return f"select bin, count(*) as n, avg(p) as pred, avg(y) as actual from (select {p} as p, {y} as y, case {cases} end as bin from {source}) where bin is not null group by 1"


_EDGES = [0, 0.1, 0.25, 0.4, 0.55, 0.7, 0.85, 1.0]


@query(
    "calibration_three_way", "I6", "bin:l n:l pred:d6 actual:d6", _bins_sql("p_home", "(outcome = 2)::int", _EDGES, True, "predictions"),
)
def _(v):
    return evaluate.calibration(v("predictions"), "p_home", F.col("outcome") == 2, _EDGES, include_lowest=True)


@query(
    "calibration_binary", "I6", "bin:l n:l pred:d6 actual:d6", _bins_sql("home_win_prob", "home_win", [i / 10 for i in range(11)], False, f"({WALK_SQL})"),
)
def _(v):
    return evaluate.calibration(_walk(v), "home_win_prob", F.col("home_win") == 1, [i / 10 for i in range(11)])


_SCORES_SQL = f"select yr, model, avg({_LL}) as log_loss from predictions group by 1, 2"


def _swept(v):
    scored = evaluate.score3(v("predictions"), ["yr", "model"])
    return evaluate.sweep(scored, "model", [1, 2, 3], fold="yr")


@query(
    "sweep_table", "I7", "yr:l a:d6 b:d6 c:d6",
    f"select yr, max(log_loss) filter (where model = 1) as a, max(log_loss) filter (where model = 2) as b, max(log_loss) filter (where model = 3) as c from ({_SCORES_SQL}) group by 1",
)
def _(v):
    return _swept(v)[0].withColumnsRenamed({"1": "a", "2": "b", "3": "c"})


@query(
    "sweep_best", "I7", "model:l log_loss:d6 best:b",
    f"""with m as (select model, avg(log_loss) as log_loss from ({_SCORES_SQL}) group by 1) select model, log_loss, log_loss = (select min(log_loss) from m) as best from m""",
)
def _(v):
    return _swept(v)[1]


@query(
    "sweep_decay_rates", "I7", "rate:d5 log_loss:d3 best:b",
)
def _(v):
    predicted = evaluate.walk_forward_goals(v("matches"), YEARS, RATES)
    scored = evaluate.score3(predicted, ["fold", "rate"])
    return evaluate.sweep(scored, "rate", RATES)[1]


_BINARY_LL = "case when outcome = 2 then -ln(least(greatest({0}, 1e-6), 1 - 1e-6)) else -ln(1 - least(greatest({0}, 1e-6), 1 - 1e-6)) end"


@query(
    "rescored_binary", "I8", "yr:l n:l binary_ll_home:d6 three_ll_home:d6 binary_acc_home:d6 three_acc_home:d6",
    f"""select a.yr, count(*) as n, avg({_BINARY_LL.format('b')}) as binary_ll_home, avg({_BINARY_LL.format('p_home')}) as three_ll_home,
          avg(((b > 0.5) = (outcome = 2))::int) as binary_acc_home, avg(((p_home > 0.5) = (outcome = 2))::int) as three_acc_home
        from predictions a join (select match_id, p_home as b from predictions where model = 2) using (match_id) where model = 1 group by 1""",
)
def _(v):
    p = v("predictions")
    binary = p.filter("model = 2").select("match_id", F.col("p_home").alias("home_win_prob"))
    return evaluate.rescore_binary(binary, p.filter("model = 1"), ["match_id"], ["yr"])


@query(
    "compared_models", "I8", "yr:l one_log_loss:d6 two_log_loss:d6",
    f"""with s as ({_SCORES_SQL}), j as (select a.yr, a.log_loss as one_log_loss, b.log_loss as two_log_loss from s a join s b using (yr) where a.model = 1 and b.model = 2)
        select * from j union all select null, avg(one_log_loss), avg(two_log_loss) from j""",
)
def _(v):
    scored = evaluate.score3(v("predictions"), ["yr", "model"])
    one, two = (scored.filter(F.col("model") == m) for m in (1, 2))
    return evaluate.compare(one, two, "yr", ["log_loss"], ("one", "two"))


@query(
    "pick_flips", "I9", "match_id:l pick_1:s pick_2:s actual:s p_home_1:d6 p_home_2:d6",
    f"""with n as (select * from (values (0, 'away'), (1, 'draw'), (2, 'home')) t(i, name)),
         p as (select *, {_PICK.format('p_away', 'p_draw', 'p_home')} as pick from predictions)
       select a.match_id, x.name as pick_1, y.name as pick_2, z.name as actual, a.p_home as p_home_1, b.p_home as p_home_2
       from p a join p b using (match_id) join n x on x.i = a.pick join n y on y.i = b.pick join n z on z.i = a.outcome
       where a.model = 1 and b.model = 2 and a.pick <> b.pick""",
)
def _(v):
    p = v("predictions")
    return evaluate.argmax_flips(p.filter("model = 1"), p.filter("model = 2"), ["match_id"])


@query(
    "pooled_scores", "I10", "model:l yr:l n:l log_loss:d6 accuracy:d6 brier:d6",
    f"""select model, yr, count(*) as n, avg({_LL}) as log_loss, avg({_HIT}) as accuracy, avg({_BRIER}) as brier
        from predictions group by grouping sets ((model, yr), (model))""",
)
def _(v):
    return evaluate.score_pooled(v("predictions"), "model", "yr")


# Feature sets, fillings and training filters, each over every year: what is missing in part of the log is filled or left out.
_BASE = ["elo_diff_norm", "log_value_diff", "outfield_age_diff", "top1_share_diff", "points_diff"]
_EXTRA = ["extra_injured", "extra_top1", "extra_top3", "extra_neutral"]
_ALL = {"features": [*_BASE, *_EXTRA], "fill": "zero", "fill_cols": _EXTRA}
CONFIGS = {
    "baseline": {"features": _BASE},
    "all, zero": _ALL,
    "all, mean": _ALL | {"fill": "mean"},
    "all, from 1997": _ALL | {"train_filter": "year(date) >= 1997"},
    "all, where known": _ALL | {"train_filter": "extra_neutral is not null"},
} | {f"with {c}": {"features": [*_BASE, c], "fill": "zero", "fill_cols": [c]} for c in _EXTRA}


def _ablated(v):
    """Features of all matches; two matches in three have the extra ones."""
    known = F.col("match_id") % 3 > 0
    values = [F.col("injury_share_diff"), F.col("injured_top1_diff"), F.col("injured_top3_diff"), F.coalesce("neutral", F.lit(False)).cast("double")]
    return labelled(v).withColumns({c: F.when(known, x) for c, x in zip(_EXTRA, values)})


@query("ablation", "I10", "config:s fold:l n:l log_loss:d2 accuracy:d2 brier:d2")
def _(v):
    return evaluate.score_pooled(evaluate.ablation(_ablated(v), CONFIGS, YEARS)[0], "config", "fold")


@query(
    "ablation_folds", "I10", "config:s fold:l n_train:l reason:s",
    f"""with m as (select cast(extract(year from date) as int) as yr, match_id from matches where home_team <> 3),
         c as (select unnest({list(CONFIGS)}) as config), f as (select unnest([1992, {', '.join(map(str, YEARS))}]) as fold),
         s as (select config, fold, count(*) filter (where yr < fold and case config when 'all, from 1997' then yr >= 1997 when 'all, where known' then match_id % 3 > 0 else true end) as n_train
           from m cross join c cross join f group by 1, 2)
       select *, case when n_train < 200 then 'fewer than 200 training rows' end as reason from s""",
)
def _(v):
    return evaluate.ablation(_ablated(v), CONFIGS, [1992, *YEARS])[1]


# --- tournament tables ----------------------------------------------------------------------------------------

_TABLE = """select *, row_number() over (partition by replicate, grp order by pts desc, gd desc, gf desc, team) as position from (
   select replicate, grp, team, sum(case when gf > ga then 3 when gf = ga then 1 else 0 end) as pts, sum(gf - ga) as gd, sum(gf) as gf from (
     select replicate, grp, home_team as team, home_score as gf, away_score as ga from replicates union all
     select replicate, grp, away_team, away_score, home_score from replicates) group by 1, 2, 3)"""
_THIRDS = f"""select * from (select *, row_number() over (partition by replicate order by pts desc, gd desc, gf desc, team) as best
   from ({_TABLE}) where position = 3) where best <= 2"""
_STAGES = f"""select replicate, grp, team, unnest(['R16', 'QF', 'final'][:greatest(4 - position, 0)]) as stage from ({_TABLE}) where position <= 3"""
_SUMMARY = f"""select team, count(*) filter (where stage = 'R16') / n as p_R16, count(*) filter (where stage = 'QF') / n as p_QF,
   count(*) filter (where stage = 'final') / n as p_final from ({_STAGES}) cross join (select count(distinct replicate) as n from ({_STAGES})) group by team, n"""


def _table(v):
    return standings.standings(v("replicates"), ["replicate", "grp"], tie=F.col("team"))


def _stages(v):
    names = F.array(*[F.lit(s) for s in ("R16", "QF", "final")])
    reached = F.explode(F.slice(names, 1, (4 - F.col("position"))))
    return _table(v).filter("position <= 3").select("replicate", "grp", "team", reached.alias("stage"))


def _summary(v):
    return standings.stage_probabilities(_stages(v), ["R16", "QF", "final"], standings.replicates(v("replicates"), "replicate"))


@query("group_standings", "E18", "replicate:t grp:l team:l pts:l gd:l gf:l position:l", _TABLE)
def _(v):
    return _table(v)


@query("best_thirds", "E19", "replicate:t team:l best:l pts:l", _THIRDS)
def _(v):
    return standings.best_of_rank(_table(v), ["replicate"], 3, 2, tie=F.col("team"))


@query(
    "finish_distributions", "E20", "team:l position:l p:d6 p_advance:d6 mean_pts:d6 mean_gd:d6 mean_gf:d6",
    f"""with t as ({_TABLE}), n as (select team, count(*) as n, count(*) filter (where position <= 2) as up from t group by 1)
        select team, position, count(*) / any_value(n) as p, any_value(up) / any_value(n) as p_advance, avg(pts) as mean_pts, avg(gd) as mean_gd, avg(gf) as mean_gf
        from t join n using (team) group by 1, 2""",
)
def _(v):
    return standings.finish_distribution(_table(v), "replicate")


@query("stage_probabilities", "E21", "team:l p_R16:d6 p_QF:d6 p_final:d6", _SUMMARY)
def _(v):
    return _summary(v)


_SHARES = f"""select grp, position, team, count(*) / n as p from ({_TABLE}) cross join (select count(distinct replicate) as n from ({_TABLE})) group by 1, 2, 3, n"""


@query(
    "slot_occupancy", "E22", "grp:l position:l team:l p:d6 place:l",
    f"select * from (select *, row_number() over (partition by grp, position order by p desc, team) as place from ({_SHARES})) where place <= 4",
)
def _(v):
    return standings.slot_occupancy(_table(v), ["grp", "position"], standings.replicates(v("replicates"), "replicate"))[0]


@query(
    "slot_modes", "E22", "grp:l position:l mode_team:l p_mode:d6",
    f"select grp, position, team as mode_team, p as p_mode from (select *, row_number() over (partition by grp, position order by p desc, team) as place from ({_SHARES})) where place = 1",
)
def _(v):
    return standings.slot_occupancy(_table(v), ["grp", "position"], standings.replicates(v("replicates"), "replicate"))[1]


@query(
    "resolved_slots", "E23", "replicate:t slot:l team_a:l team_b:l",
    f"""with t as ({_TABLE}), b as ({_THIRDS}),
         s as (select * from (values (1, 'a', 0, 1), (1, 'b', 1, 2), (2, 'a', 2, 1), (3, 'a', 3, 1), (3, 'b', 4, 2), (4, 'a', 4, 1)) x(slot, side, grp, position)),
         u as (select replicate, slot, side, team from t join s using (grp, position) union all
               select replicate, case best when 1 then 2 else 4 end, 'b', team from b)
       select replicate, slot, max(team) filter (where side = 'a') as team_a, max(team) filter (where side = 'b') as team_b from u group by 1, 2""",
)
def _(v):
    pairs = [(("0", 1), ("1", 2)), (("2", 1), ("T", None)), (("3", 1), ("4", 2)), (("4", 1), ("T", None))]
    table = _table(v).withColumn("grp", F.col("grp").cast("string"))
    return standings.resolve_slots(table, standings.slot_table(v.spark, pairs), ["replicate"], tie=F.col("team"))


# A tournament of 48 entrants a year, from group tables to the final, with exact chances.
_ENTRANT = "o_custkey % 48"
_SEASON_SQL = f"""select yr, team, chr(65 + cast(team % 12 as int)) as grp, pts, row_number() over (partition by yr, team % 12 order by pts desc, team) as position
   from (select cast(extract(year from o_orderdate) as int) as yr, {_ENTRANT} as team, cast(sum(floor(o_totalprice)) as bigint) as pts from orders group by 1, 2)"""
_POISSON = ["exp(-{0}) * pow({0}, g) / factorial(g::int)".format(x) for x in ("lh", "la", "lh / 3", "la / 3")]
_BEATS_SQL = f"""select team, other, max(case kind when 0 then w end) + max(case kind when 0 then d end) * max(case kind when 1 then w + d / 2 end) as p from (
     select x.team, x.other, x.kind, sum(x.p * y.q) filter (where x.g > y.g) / sum(x.p * y.q) as w, sum(x.p * y.q) filter (where x.g = y.g) / sum(x.p * y.q) as d
     from c x join c y on x.team = y.team and x.other = y.other and x.kind = y.kind group by 1, 2, 3) group by 1, 2"""
_STRENGTH = "({0} - 24) / 60.0e0"


def _bracket_sql() -> str:
    places = [(73 + k, name, grp, position) for k, pair in enumerate(KNOCKOUT_48) for name, (grp, position) in zip("ab", pair)]
    fixed = ", ".join(f"({slot}, '{name}', '{grp}', {position})" for slot, name, grp, position in places if position)
    thirds = ", ".join(f"({slot}, '{name}', {k + 1})" for k, (slot, name) in enumerate((s, n) for s, n, _, position in places if not position))
    stages = list(dict.fromkeys(w[0] for w in LATER_ROUNDS_48))
    ctes = [
        f"t as ({_SEASON_SQL})", "e as (select distinct team from t)",
        f"r as (select a.team, b.team as other, exp({_STRENGTH.format('a.team')} + {_STRENGTH.format('b.team')} * 0.5) as lh, exp({_STRENGTH.format('b.team')} + {_STRENGTH.format('a.team')} * 0.5) as la from e a, e b where a.team <> b.team)",
        f"""c as (select team, other, 0 as kind, g, {_POISSON[0]} as p, {_POISSON[1]} as q from r, (select unnest(range(11)) as g)
             union all select team, other, 1, g, {_POISSON[2]}, {_POISSON[3]} from r, (select unnest(range(11)) as g))""",
        f"beats as ({_BEATS_SQL})",
        f"""m0 as (select yr, slot, side, team, 1.0e0 as p_play from t join (select * from (values {fixed}) s(slot, side, grp, position)) using (grp, position)
             union all select yr, slot, side, team, 1.0e0 from (select *, row_number() over (partition by yr order by pts desc, team) as k from t where position = 3)
             join (select * from (values {thirds}) s(slot, side, k)) using (k))""",
    ]
    for k, stage in enumerate(["R32", *stages]):
        ctes.append(f"""w{k} as (select x.yr, x.slot, x.side, x.team, x.p_play, x.p_play * (coalesce(sum(y.p_play * p), 0) + 1 - coalesce(sum(y.p_play), 0)) as p_win
             from m{k} x left join m{k} y on x.yr = y.yr and x.slot = y.slot and x.side <> y.side left join beats on beats.team = x.team and beats.other = y.team group by 1, 2, 3, 4, 5)""")
        if k < len(stages):
            feeds = ", ".join(f"({source}, '{name}', {slot})" for later, slot, a, b in LATER_ROUNDS_48 if later == stages[k] for name, source in (("a", a), ("b", b)))
            ctes.append(f"m{k + 1} as (select yr, f.next as slot, f.into_side as side, team, p_win as p_play from w{k} join (select * from (values {feeds}) f(slot, into_side, next)) f using (slot))")
    rows = " union all ".join(f"select yr, '{stage}' as stage, slot, team, p_play, p_win from w{k}" for k, stage in enumerate(["R32", *stages]))
    return f"with {', '.join(ctes)} {rows}"


@query("bracket_chances", "E21", "yr:l stage:s slot:l team:l p_play:d6 p_win:d6", _bracket_sql())
def _(v):
    seasons = v.sql(_SEASON_SQL.replace("chr(65 + cast(team % 12 as int))", "char(65 + cast(team % 12 as int))")).withColumns({"gd": F.lit(0), "gf": F.lit(0)})
    fixtures = standings.resolve_slots(seasons, standings.slot_table(v.spark, KNOCKOUT_48, 73), ["yr"], tie=F.col("team"))
    pairs = matchups.unordered_pairs(seasons)
    a, b = ((F.col(f"team_{x}") - 24) / 60.0 for x in "ab")
    rated = pairs.withColumns({"lam_home": F.exp(a + b * 0.5), "lam_away": F.exp(b + a * 0.5)})
    rated = goals.independent_poisson_probs(rated.withColumnsRenamed({"lam_home": "exp_home_goals", "lam_away": "exp_away_goals"}))
    rated = goals.knockout_chance(rated, "exp_home_goals", "exp_away_goals")
    p = F.col("p_through")
    way = [F.struct(F.col(f"team_{x}").alias("team"), F.col(f"team_{y}").alias("other"), q.alias("p")) for x, y, q in (("a", "b", p), ("b", "a", 1 - p))]
    beats = rated.select(F.explode(F.array(*way)).alias("w")).select("w.*")
    return standings.bracket_probabilities(fixtures, beats, LATER_ROUNDS_48, ["yr"], "R32")


# --- profiles -------------------------------------------------------------------------------------------------


@query(
    "label_counts", "E16", "tournament:s count:l",
    "select tournament, count(*) as count from matches where tournament is not null group by 1 order by 2 desc, 1 limit 20",
)
def _(v):
    return profile.label_counts(v("matches"), "tournament", 20)


@query("distinct_labels", "E16", "tournament:s", "select distinct tournament from matches")
def _(v):
    return profile.distinct_labels(v("matches"), "tournament")


@query(
    "goals_per_year", "E16", "year:l home_score:d6 away_score:d6",
    "select extract(year from date) as year, avg(home_score) as home_score, avg(away_score) as away_score from matches group by 1",
)
def _(v):
    return profile.goals_per_year(v("matches"))


@query(
    "outcome_shares", "E16", "result:s share:d6",
    f"select case o when 2 then 'home' when 1 then 'draw' else 'away' end as result, count(*) / (select count(*) from matches) as share from (select {_TRUTH} as o from matches) group by 1",
)
def _(v):
    return profile.outcome_shares(v("matches"))


@query(
    "both_present", "E16", "present:l rows:l", "select count(*) filter (where from_team_id is not null and to_team_id is not null) as present, count(*) as rows from transfers",
)
def _(v):
    return profile.both_present(v("transfers"), "from_team_id", "to_team_id")


@query(
    "described", "E17", "name:s count:l mean:d4 std:d4 min:d2 q25:d2 q50:d2 q75:d2 max:d2",
    " union all ".join(
        f"""select '{c}' as name, count({c}) as count, avg({c}) as mean, stddev_samp({c}) as std, min({c}) as min, quantile_cont({c}, 0.25) as q25,
        quantile_cont({c}, 0.5) as q50, quantile_cont({c}, 0.75) as q75, max({c}) as max from orders""" for c in ("o_totalprice", "o_custkey")
    ),
)
def _(v):
    return profile.describe(v("orders"), ["o_totalprice", "o_custkey"])


@query("correlation", "E17", "corr:d6", "select corr(home_score, away_score) as corr from matches")
def _(v):
    return profile.corr(v("matches"), "home_score", "away_score")


@query(
    "grouped_coverage", "E24", "year:l league:s size:l with_tournament:l with_neutral:l distinct_home_team:l",
    """select extract(year from date) as year, league, count(*) as size, count(tournament) as with_tournament, count(neutral) as with_neutral,
         count(distinct home_team) as distinct_home_team from matches group by 1, 2""",
)
def _(v):
    return profile.grouped_coverage(v("matches").withColumn("year", F.year("date")), ["year", "league"], ["tournament", "neutral"], ["home_team"])


# --- viewer ---------------------------------------------------------------------------------------------------


@query("top_contenders", "V1", "team:l p_final:d6", f"select * from ({_SUMMARY}) order by p_final desc, team limit 16")
def _(v):
    return standings.top_contenders(_summary(v), "p_final", 16)


@query("lowest_teams", "V1", "team:l p_R16:d6", f"select * from ({_SUMMARY}) order by p_R16, team limit 8")
def _(v):
    return standings.top_contenders(_summary(v), "p_R16", 8, lowest=True)


@query(
    "group_tables", "V2", "grp:l team:l p_R16:d6 place:l",
    f"""select n_nationkey % 5 as grp, team, p_R16, row_number() over (partition by n_nationkey % 5 order by p_R16 desc, team) as place
        from nation join ({_SUMMARY}) on team = n_nationkey""",
)
def _(v):
    groups = v("nation").select((F.col("n_nationkey") % 5).alias("grp"), F.col("n_nationkey").alias("team"))
    return standings.group_table(groups, _summary(v), "grp", "p_R16")


@query(
    "pair_lookups", "V3", "match_id:l p_first:d6 p_draw:d6 p_second:d6",
    f"""select match_id, case when home_team < away_team then p_a_wins else p_b_wins end as p_first, p_draw,
          case when home_team < away_team then p_b_wins else p_a_wins end as p_second
        from matches join ({GRID_SQL}) on team_a = least(home_team, away_team) and team_b = greatest(home_team, away_team)""",
)
def _(v):
    return standings.pair_lookup(v("matches"), matchup_table(v), "home_team", "away_team")
