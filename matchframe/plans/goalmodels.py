"""Goal models, pair scoring, outcome models."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchframe.functions import scores
from matchframe.operators import clean, goals, logits, matchups, outcome
from matchframe.operators.asof import latest_snapshot_per_entity
from matchframe.plans.matchlog import featured, rated
from matchframe.plans.registry import QUERIES, query
from matchframe.session import small_table

# Fixed strengths, so that likelihoods and predictions can be compared.
_PARAMS_SQL = "select n_nationkey as team, (n_nationkey - 12) / 60.0e0 as alpha, (12 - n_nationkey) / 90.0e0 as beta from nation where n_nationkey <> 24"
_RATES_SQL = f"""select m.*, exp(coalesce(h.alpha, 0) - coalesce(a.beta, 0) + case when coalesce(neutral, false) then 0 else 0.25 end) as lh,
    exp(coalesce(a.alpha, 0) - coalesce(h.beta, 0)) as la
  from matches m left join ({_PARAMS_SQL}) h on home_team = h.team left join ({_PARAMS_SQL}) a on away_team = a.team"""
_TAU = "case when {h} = 0 and {a} = 0 then 1 - lh * la * {r} when {h} = 0 and {a} = 1 then 1 + lh * {r} when {h} = 1 and {a} = 0 then 1 + la * {r} when {h} = 1 and {a} = 1 then 1 - {r} else 1.0 end"


def _grid_sql(rates: str, rho: str) -> str:
    tau = _TAU.format(h="x.g", a="y.g", r=rho)
    return f"""select match_id, x.g as h, y.g as a, exp(-lh) * pow(lh, x.g) / factorial(x.g::int) * exp(-la) * pow(la, y.g) / factorial(y.g::int) * ({tau}) as p
      from ({rates}) cross join range(11) x(g) cross join range(11) y(g)"""


def _probs_sql(rates: str, rho: str) -> str:
    return f"""select match_id, sum(p) filter (where h < a) / sum(p) as p_away, sum(p) filter (where h = a) / sum(p) as p_draw,
       sum(p) filter (where h > a) / sum(p) as p_home from ({_grid_sql(rates, rho)}) group by 1"""


def _params(v):
    team = F.col("n_nationkey")
    teams = v("nation").filter(team != 24).select(
        F.lit(0).alias("fit"), team.alias("team"), ((team - 12) / 60).alias("alpha"), ((12 - team) / 90).alias("beta")
    )
    return teams, small_table(v.spark, [(0, 0.25, -0.1)], "fit int, gamma double, rho double")


def _league_params(v):
    """The same strengths for each league's fit, the 25th team at 0; gamma and rho by league."""
    leagues = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    team, known = F.col("n_nationkey"), F.col("n_nationkey") != 24
    teams = v("nation").select(
        F.explode(F.array(*[F.lit(x) for x in leagues])).alias("fit"), team.alias("team"),
        F.when(known, (team - 12) / 60).otherwise(0.0).alias("alpha"), F.when(known, (12 - team) / 90).otherwise(0.0).alias("beta"),
    )
    return teams, small_table(v.spark, [(x, 0.25, -0.1) for x in leagues], "fit string, gamma double, rho double")


def _rated(v):
    return goals.predict_rates(v("matches"), *_params(v))


_FIT_RATES = f"""select m.*, exp(coalesce(h.alpha, 0) - coalesce(a.beta, 0) + 0.25) as lh, exp(coalesce(a.alpha, 0) - coalesce(h.beta, 0)) as la,
    exp(-0.0018 * date_diff('day', date, (select max(date) from matches))) as w
  from matches m left join ({_PARAMS_SQL}) h on home_team = h.team left join ({_PARAMS_SQL}) a on away_team = a.team"""


@query(
    "goal_likelihood", "H1", "fit:s nll:d4",
    f"""select league as fit, -sum(w * (home_score * ln(lh) - lh + away_score * ln(la) - la + ln({_TAU.format(h='home_score', a='away_score', r='-0.1')}))) as nll
        from ({_FIT_RATES}) group by 1""",
)
def _(v):
    return goals.goal_model_likelihood(goals.pair_sums(v("matches"), "league", xi=0.0018), *_league_params(v))


@query("goal_fit", "H1", "fit:l team:l attack:d3 defense:d3 total:d3")
def _(v):
    return goals.params_table(goals.goal_model_fit(goals.pair_sums(v("matches"), xi=0.0018)))


_FEATURES = ["elo", "logv", "fpts"]
# Side features as in clean.side_features over the synthetic columns of the match log.
_SIDES_SQL = """select m.*, (1400.0 + home_team * 8) / 100 as home_elo, (1400.0 + away_team * 8) / 100 as away_elo,
    case when home_team <> 3 then log10(greatest(home_team * 90000.0, 100000.0)) end as home_logv, log10(greatest(away_team * 90000.0, 100000.0)) as away_logv,
    case when match_id % 5 = 0 then 0 else (1000 + home_team * 10) / 1000.0e0 end as home_fpts, (1000 + away_team * 10) / 1000.0e0 as away_fpts from matches m"""
_MODEL = goals.GoalRegression(_FEATURES, [14.9, 5.8, 1.1], [0.05, 0.1, -0.2], [0.02, -0.05, 0.1], 0.2, -0.08)


def _sides(v):
    return v("matches").join(clean.side_features(featured(v)).drop("neutral"), "match_id")


def _dot(side: str, weights) -> str:
    return " + ".join(f"({side}_{c} - {m}) * {w}" for c, m, w in zip(_FEATURES, _MODEL.means, weights))


_REG_RATES = f"""select *, exp({_dot('home', _MODEL.attack)} - ({_dot('away', _MODEL.defense)}) + {{gamma}}) as lh,
    exp({_dot('away', _MODEL.attack)} - ({_dot('home', _MODEL.defense)})) as la from ({_SIDES_SQL}) where home_logv is not null"""


@query(
    "goal_regression_likelihood", "H2", "nll:d4",
    f"""select -sum(w * (home_score * ln(lh) - lh + away_score * ln(la) - la + ln({_TAU.format(h='home_score', a='away_score', r='-0.08')}))) as nll
        from (select *, exp(-0.0018 * date_diff('day', date, (select max(date) from matches where home_team <> 3))) as w from ({_REG_RATES.format(gamma='0.2')}))""",
)
def _(v):
    rows = goals.regression_rows(_sides(v), _FEATURES, 0.0018)
    m = _MODEL
    params = goals.regression_params(v.spark, m.means, m.attack, m.defense, m.gamma, m.rho)
    return goals.goal_regression_likelihood(rows, params, len(_FEATURES))


@query("goal_regression_fit", "H2", "feature:s attack_weight:d3 defense_weight:d3")
def _(v):
    return goals.coefficients(v.spark, goals.goal_regression_fit(_sides(v), _FEATURES, 0.00038))


@query(
    "score_grid_means", "H3", "home_goals:l away_goals:l p:d6",
    f"select h as home_goals, a as away_goals, avg(p) as p from ({_grid_sql(_RATES_SQL, '-0.1')}) group by 1, 2",
)
def _(v):
    return goals.score_grid(_rated(v), ["match_id"], F.col("rho")).groupBy("home_goals", "away_goals").agg(F.avg("p").alias("p"))


@query("outcome_probs", "H4", "match_id:l p_away:d6 p_draw:d6 p_home:d6", _probs_sql(_RATES_SQL, "-0.1"))
def _(v):
    return goals.outcome_probs(_rated(v), F.col("rho"))


@query(
    "most_likely_scores", "H5", "match_id:l most_likely_score:s most_likely_p:d6",
    f"""select match_id, arg_max(h || '-' || a, row(round_even(p * 1e12, 0), -h, -a)) as most_likely_score, max(p) / sum(p) as most_likely_p
        from ({_grid_sql(_RATES_SQL, '-0.1')}) group by 1""",
)
def _(v):
    return goals.most_likely_score(_rated(v), F.col("rho"))


@query(
    "goal_predictions", "H6", "match_id:l lam_home:d6 lam_away:d6 p_away:d6 p_draw:d6 p_home:d6",
    f"select * from (select match_id, lh as lam_home, la as lam_away from ({_RATES_SQL})) join ({_probs_sql(_RATES_SQL, '-0.1')}) using (match_id)",
)
def _(v):
    return goals.predict_many(v("matches"), *_params(v))


@query(
    "goal_regression_predictions", "H6", "match_id:l p_away:d6 p_draw:d6 p_home:d6",
    _probs_sql(_REG_RATES.format(gamma="case when coalesce(neutral, false) then 0 else 0.2 end"), "-0.08"),
)
def _(v):
    return goals.regression_predict_many(_sides(v).filter(F.col("home_logv").isNotNull()), _MODEL)


@query(
    "goal_parameters", "H7", "team:l attack:d6 defense:d6 total:d6",
    f"select team, alpha as attack, beta as defense, alpha + beta as total from ({_PARAMS_SQL})",
)
def _(v):
    return goals.params_table(goals.GoalModel(*_params(v)))


@query(
    "independent_poisson", "H8", "match_id:l p_away:d6 p_draw:d6 p_home:d6", _probs_sql(_RATES_SQL, "0.0"),
)
def _(v):
    rows = _rated(v).withColumnsRenamed({"lam_home": "exp_home_goals", "lam_away": "exp_away_goals"})
    return goals.independent_poisson_probs(rows)


LOGIT = outcome.Logit(["diff"], [-0.2, -0.1, 0.3], [[-0.9], [0.05], [0.85]])
_DIFF = "(home_elo_pre + case when coalesce(neutral, false) then 0 else 100 end - away_elo_pre) / 400.0e0"
_RATED_SQL = "select *, 1400.0e0 + home_team * 8 as home_elo_pre, 1400.0e0 + away_team * 8 as away_elo_pre from matches"


def _logit_sql(source: str, keys: str, diff: str) -> str:
    e = [f"exp({i} + ({w[0]}) * ({diff}))" for i, w in zip(LOGIT.intercepts, LOGIT.weights)]
    return f"""select {keys}, e0 / (e0 + e1 + e2) as p_away, e1 / (e0 + e1 + e2) as p_draw, e2 / (e0 + e1 + e2) as p_home
      from (select *, {e[0]} as e0, {e[1]} as e1, {e[2]} as e2 from ({source}))"""


@query("draw_model_predictions", "H9", "match_id:l p_away:d6 p_draw:d6 p_home:d6", _logit_sql(_RATED_SQL, "match_id", _DIFF))
def _(v):
    return outcome.draw_model_predict(rated(v), LOGIT, "home_elo_pre", "away_elo_pre")


@query("draw_model_fit", "H9", "class:l term:s value:d3")
def _(v):
    return outcome.logit_table(v.spark, outcome.draw_model_fit(rated(v)))


FEATURES = ["elo_diff_norm", "outfield_age_diff", "top1_share_diff", "points_diff"]
ALL_FEATURES = [*FEATURES, "log_value_diff", "injury_share_diff", "injured_top1_diff", "injured_top3_diff"]


def labelled(v):
    """Feature rows with their outcome, for the classifiers."""
    rows = clean.diff_features(featured(v)).drop("neutral").join(v("matches"), "match_id")
    return rows.withColumn("outcome", scores.outcome(F.col("home_score"), F.col("away_score")))


@query("feature_logit", "H10", "class:l term:s value:d3")
def _(v):
    return outcome.logit_table(v.spark, outcome.feature_logit(labelled(v), ALL_FEATURES))


# Fixed coefficients of two feature sets and two folds, for the likelihood that the fits climb.
_FOLDS = [1998, 2001]
_SETS = {"two": (FEATURES[:2], None), "all": (ALL_FEATURES, None), "all, mean": (ALL_FEATURES, "mean")}
_FILLED = ["log_value_diff"]


def _coefficients(features: list[str]) -> list[list[float]]:
    return [[0.1 * (i - 1), *[0.05 * (i - 1) * (j % 3 - 0.5) for j in range(len(features))]] for i in range(3)]


def _likelihood_sql() -> str:
    ctes, selects = [], []
    for k, (name, (features, how)) in enumerate(_SETS.items()):
        w, x = _coefficients(features), ["1.0e0", *features]
        held = [f"coalesce({c}, avg({c}) over (partition by fold)) as {c}" if how and c in _FILLED else c for c in features]
        z = [" + ".join(f"({c}) * ({v!r})" for c, v in zip(x, w[i])) + f" as z{i}" for i in range(3)]
        whole = " and ".join(f"{c} is not null" for c in features)
        penalty = sum(v * v for row in w for v in row[1:]) / 2
        sums = [f"sum(((outcome = {i})::int - exp(z{i} - lse)) * ({c})) as g{i}_{j}" for i in range(3) for j, c in enumerate(x)]
        ctes.append(f"""s{k} as (select fold, count(*) as n, sum(case outcome when 0 then z0 when 1 then z1 else z2 end - lse) - ({penalty!r}) as ll, {", ".join(sums)}
          from (select *, ln(exp(z0) + exp(z1) + exp(z2)) as lse from (select *, {", ".join(z)} from (
            select fold, outcome, {", ".join(held)} from l join folds on yr < fold) where {whole})) group by fold)""")
        for i in range(3):
            for j, term in enumerate(["intercept", *features]):
                pull = f" - ({w[i][j]!r})" if j else ""
                selects.append(f"select '{name}' as config, fold, n, ll as log_likelihood, {i} as class, '{term}' as term, g{i}_{j}{pull} as gradient from s{k}")
    truth = "case when home_score > away_score then 2 when home_score = away_score then 1 else 0 end"
    return f"""with folds as (select unnest({_FOLDS}) as fold),
      l as (select d.*, cast(extract(year from date) as int) as yr, {truth} as outcome from ({QUERIES["diff_features"].sql}) d join matches using (match_id)),
      {", ".join(ctes)} {" union all ".join(selects)}"""


@query("logit_likelihood", "H10", "config:s fold:l n:l log_likelihood:d5 class:l term:s gradient:d5", _likelihood_sql())
def _(v):
    fits, models = [], []
    for name, (features, how) in _SETS.items():
        w = _coefficients(features)
        for y in _FOLDS:
            fits.append(logits.Fit(name, tuple(features), y, fill=how, fill_cols=tuple(_FILLED if how else ())))
            models.append(logits.Logit(features, [r[0] for r in w], [r[1:] for r in w]))
    rows = labelled(v).withColumn("yr", F.year("date"))
    return logits.likelihood(rows, logits.Grid(fits, models), at="yr")


@query("boosted_trees", "H11", "match_id:l p_away:d3 p_draw:d3 p_home:d3")
def _(v):
    rows = labelled(v)
    return outcome.boosted_predict(rows, outcome.boosted_trees(rows, FEATURES, rounds=3))


@query("perceptron", "H12", "match_id:l p_away:d3 p_draw:d3 p_home:d3")
def _(v):
    rows = labelled(v)
    scaled = outcome.standardise(rows, rows, FEATURES)
    return outcome.mlp_predict(scaled, outcome.mlp(scaled, FEATURES))


@query(
    "standardised", "H13", "match_id:l home_score:d6 away_score:d6",
    """with s as (select avg(home_score) as mh, stddev_pop(home_score) as sh, avg(away_score) as ma, stddev_pop(away_score) as sa from matches where date < timestamp '1999-01-01 00:00:00')
       select match_id, (home_score - mh) / sh as home_score, (away_score - ma) / sa as away_score from matches, s""",
)
def _(v):
    train = v("matches").filter(F.col("date") < F.lit("1999-01-01").cast("timestamp_ntz"))
    return outcome.standardise(train, v("matches"), ["home_score", "away_score"])


@query("feature_importances", "H14", "feature:s importance:d3")
def _(v):
    return outcome.feature_importance(v.spark, outcome.boosted_trees(labelled(v), FEATURES, rounds=3))


@query(
    "ensemble_averages", "H15", "match_id:l p_away:d6 p_draw:d6 p_home:d6",
    """select match_id, a / (a + d + h) as p_away, d / (a + d + h) as p_draw, h / (a + d + h) as p_home
       from (select match_id, avg(p_away) as a, avg(p_draw) as d, avg(p_home) as h from predictions where model in (1, 3) group by 1)""",
)
def _(v):
    return outcome.ensemble_average(v("predictions"), ["match_id"], [1, 3])


_CLIP = "least(greatest({}, 1e-6), 1 - 1e-6)"
LL_SQL = f"""-ln({_CLIP.format("case outcome when 0 then {0} when 1 then {1} else {2} end")})"""
_WIDE_SQL = "select match_id, yr, outcome, " + ", ".join(
    f"max({c}) filter (where model = {m}) as {c}_{m}" for m in (1, 2, 3) for c in outcome.TRIPLE
) + " from predictions group by 1, 2, 3"
_MIXED = ", ".join(f"w0 * {c}_1 + w1 * {c}_2 + w2 * {c}_3 as m_{c}" for c in outcome.TRIPLE)
_BLENDED = f"""select w0, w1, w2, yr, outcome, m_p_away / (m_p_away + m_p_draw + m_p_home) as p_away, m_p_draw / (m_p_away + m_p_draw + m_p_home) as p_draw,
   m_p_home / (m_p_away + m_p_draw + m_p_home) as p_home
   from (select *, {_MIXED} from ({_WIDE_SQL}) cross join (select x.i / 10.0e0 as w0, y.j / 10.0e0 as w1, (10 - x.i - y.j) / 10.0e0 as w2
     from range(11) x(i) cross join range(11) y(j) where x.i + y.j <= 10))"""


def _wide(v):
    return outcome.side_by_side(v("predictions"), ["match_id", "yr", "outcome"], [1, 2, 3])


@query(
    "ensemble_weight_scores", "H16", "w0:d1 w1:d1 w2:d1 log_loss:d6",
    f"select w0, w1, w2, avg({LL_SQL.format('p_away', 'p_draw', 'p_home')}) as log_loss from ({_BLENDED}) where yr = 1999 group by 1, 2, 3",
)
def _(v):
    return outcome.weight_scores(_wide(v).filter("yr = 1999"), [1, 2, 3])


@query(
    "ensemble_weight_search", "H16", "w0:d1 w1:d1 w2:d1 test_log_loss:d6 test_accuracy:d6",
    f"""with b as ({_BLENDED}), s as (select w0, w1, w2, avg({LL_SQL.format('p_away', 'p_draw', 'p_home')}) filter (where yr = 1999) as tune,
          avg({LL_SQL.format('p_away', 'p_draw', 'p_home')}) filter (where yr = 2000) as test_log_loss,
          avg((case when p_away >= p_draw and p_away >= p_home then 0 when p_draw >= p_home then 1 else 2 end = outcome)::int) filter (where yr = 2000) as test_accuracy
          from b group by 1, 2, 3)
        select w0, w1, w2, test_log_loss, test_accuracy from s order by round(tune, 12), w0, w1 limit 1""",
)
def _(v):
    wide = _wide(v)
    return outcome.weight_grid_search(wide.filter("yr = 1999"), wide.filter("yr = 2000"), [1, 2, 3])


@query("stacked", "H17", "match_id:l p_away:d3 p_draw:d3 p_home:d3")
def _(v):
    years = [r[0] for r in v("predictions").select("yr").distinct().orderBy("yr").collect()]
    return outcome.stack(_wide(v), [1, 2, 3], years[1:], fold="yr")


# Pairings of all teams, scored from their latest ratings.
_SNAP_SQL = """select team, elo from (select home_team as team, date, 1 as home, match_id, 1400.0e0 + home_team * 8 + home_score as elo from matches
     union all select away_team, date, 0, match_id, 1400.0e0 + away_team * 8 + away_score from matches)
   qualify row_number() over (partition by team order by date desc, home desc, match_id desc) = 1"""
_ORIENTED = _logit_sql(
    f"select h.team as home, a.team as away, h.elo as he, a.elo as ae from ({_SNAP_SQL}) h join ({_SNAP_SQL}) a on h.team <> a.team", "home, away", "(he - ae) / 400.0e0"
)
GRID_SQL = f"""select x.home as team_a, x.away as team_b, (x.p_home + y.p_away) / 2 as p_a_wins, (x.p_draw + y.p_draw) / 2 as p_draw, (x.p_away + y.p_home) / 2 as p_b_wins
   from ({_ORIENTED}) x join ({_ORIENTED}) y on x.home = y.away and x.away = y.home and x.home < x.away"""


def matchup_table(v):
    rows = v("matches").withColumns(
        {"home_elo": 1400.0 + F.col("home_team") * 8 + F.col("home_score"), "away_elo": 1400.0 + F.col("away_team") * 8 + F.col("away_score")}
    )
    snapshot = latest_snapshot_per_entity(rows, ["elo"])
    pairs = matchups.unordered_pairs(snapshot)
    oriented = matchups.both_orientations(pairs, snapshot, ["elo"])
    return matchups.matchup_grid(outcome.draw_model_predict(oriented, LOGIT, "home_elo", "away_elo"))


@query("matchup_grid", "H18", "team_a:l team_b:l p_a_wins:d6 p_draw:d6 p_b_wins:d6", GRID_SQL)
def _(v):
    return matchup_table(v)


@query(
    "rating_diff_curve", "H19", "rating_diff:d6 p_away:d6 p_draw:d6 p_home:d6 expected_score:d6 n_matches:l",
    f"""with c as ({_logit_sql("select -400.0e0 + i * (800.0e0 / 199) as rating_diff from range(200) t(i)", "rating_diff", "rating_diff / 400.0e0")}),
         m as (select least(greatest(cast(floor((400 + (home_team - away_team) * 8) / (800.0e0 / 199)) as int), 0), 199) as i, count(*) as n from matches group by 1)
       select c.*, 1 / (1 + pow(10.0e0, -rating_diff / 400.0e0)) as expected_score, coalesce(n, 0) as n_matches
       from c left join m on i = cast(round((rating_diff + 400) / (800.0e0 / 199)) as int)""",
)
def _(v):
    step = 800 / 199
    cell = F.floor((400 + (F.col("home_team") - F.col("away_team")) * 8) / step).cast("int")
    played = v("matches").groupBy(F.least(F.greatest(cell, F.lit(0)), F.lit(199)).alias("i")).agg(F.count(F.lit(1)).alias("n"))
    curve = outcome.probability_curve(v.spark, LOGIT).withColumn("i", F.round((F.col("rating_diff") + 400) / step).cast("int"))
    return curve.join(played, "i", "left").withColumn("n_matches", F.coalesce("n", F.lit(0)))


@query(
    "implied_strengths", "H20", "team:l attack:d6 defense:d6 skill:d6",
    f"""with l as (select home_team as team, date, 1 as home, match_id, home_elo as elo, home_logv as logv, home_fpts as fpts from ({_SIDES_SQL})
          union all select away_team, date, 0, match_id, away_elo, away_logv, away_fpts from ({_SIDES_SQL})),
         s as (select * from l qualify row_number() over (partition by team order by date desc, home desc, match_id desc) = 1),
         t as (select team, {" + ".join(f"({c} - {m}) * {w}" for c, m, w in zip(_FEATURES, _MODEL.means, _MODEL.attack))} as attack,
           {" + ".join(f"({c} - {m}) * {w}" for c, m, w in zip(_FEATURES, _MODEL.means, _MODEL.defense))} as defense from s)
       select *, attack + defense as skill from t""",
)
def _(v):
    return goals.implied_strengths(latest_snapshot_per_entity(_sides(v), _FEATURES), _MODEL)
