"""Properties of ratings and fitted models."""

import random
import subprocess
import sys

import numpy as np
import pytest
from conftest import rows
from pyspark import cloudpickle
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from matchframe.operators import asof, evaluate, goals, outcome, ratings, windows
from matchframe.session import small_table


@pytest.fixture(scope="module")
def matches(spark):
    rng = random.Random(3)
    data = []
    for i in range(600):
        h, a = rng.sample(range(8), 2)
        data.append((i, i // 2, h, a, rng.choice([0, 0, 1, 1, 2, 3]), rng.choice([0, 0, 1, 2]), "xy"[i % 2], rng.choice([True, False, None]),
                     rng.choice(["FIFA World Cup", "UEFA Euro", None]), h / 4, a / 4, (i % 7) / 7, (i % 5) / 5))
    df = small_table(
        spark, data, "match_id long, d int, home_team int, away_team int, home_score int, away_score int, league string, neutral boolean, "
        "tournament string, home_f double, away_f double, home_g double, away_g double",
    )
    day = F.timestamp_add("DAY", F.col("d") * 4, F.lit("2019-01-01").cast("timestamp_ntz"))
    return df.withColumn("date", day).drop("d").cache()


def test_rating_sum_is_constant_without_regression(spark, matches):
    states = ratings.elo_states(matches, params=ratings.RatingParams(regression=0.0))
    sums = ratings.last_state(states).groupBy("key").agg(F.avg("r0")).collect()
    assert all(abs(s - 1500) < 1e-6 for _, s in sums)


def test_fold_of_a_key_does_not_depend_on_others(spark, matches):
    whole = ratings.elo_fold(matches).filter("key = 'x'")
    assert rows(whole) == rows(ratings.elo_fold(matches.filter("league = 'x'")))


def test_regression_happens_once_per_gap(spark):
    df = small_table(spark, [(1, "2000-05-01", 1, 2), (2, "2005-05-01", 1, 2)], "match_id long, day string, home_team int, away_team int").select(
        "match_id", F.col("day").cast("timestamp_ntz").alias("date"), "home_team", "away_team", F.lit(2).alias("home_score"), F.lit(0).alias("away_score"),
        F.lit("l").alias("league"), F.lit(True).alias("neutral"), F.lit("FIFA World Cup").alias("tournament"),
    )
    first, second = ratings.elo_fold(df).orderBy("match_id").collect()
    # weight 2.0 times margin 1.5 is capped at 2.0: k = 64, an even game moves 32 points
    assert (first.k_adjusted, first.home_win_prob) == (64.0, 0.5)
    assert round(second.home_elo_pre, 9) == round(1500 + 0.9 * 32, 9) and round(second.away_elo_pre, 9) == round(1500 - 0.9 * 32, 9)


@pytest.mark.parametrize("kind", ["single", "attack_defense"])
def test_periods_equal_one_pass(spark, matches, kind):
    fold, states = {
        "single": (ratings.elo_fold, ratings.elo_states), "attack_defense": (ratings.attack_defense_fold, ratings.attack_defense_states)
    }[kind]
    parts, state = ratings.fold_in_periods(matches, [2020, 2021], kind=kind)
    assert rows(parts) == rows(fold(matches))
    final = ratings.last_state(states(matches))
    assert rows(state.select(*final.columns)) == rows(final)


def test_tasks_need_no_import_of_the_package(tmp_path):
    payload = cloudpickle.dumps(ratings._folder(ratings._Single, ratings.RatingParams(), True, True, []))
    (tmp_path / "fold").write_bytes(payload)
    code = f"import pickle; pickle.load(open({str(tmp_path / 'fold')!r}, 'rb')); import sys; assert 'matchframe' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=60)


def test_asof_never_looks_ahead(spark, matches):
    right = matches.select(F.col("home_team").alias("k"), F.col("date").alias("at"), "match_id")
    got = asof.asof(matches, right, ["away_team"], ["k"], "date", "at", {"at": "seen"}, ["match_id"], ["match_id"])
    assert got.filter(F.col("seen") > F.col("date")).count() == 0 and got.count() == 600


def test_wide_of_long_is_identity(spark, matches):
    wide = windows.to_wide(windows.to_long(matches), ["team", "gf"])
    want = matches.select("match_id", "home_team", F.col("home_score").alias("home_gf"), "away_team", F.col("away_score").alias("away_gf"))
    assert rows(wide.select(*want.columns)) == rows(want)


def test_grid_and_probabilities_agree(spark, matches):
    df = matches.limit(20).withColumns({"lam_home": 0.4 + F.col("match_id") / 9, "lam_away": 1.1 + F.col("home_f")})
    grid = goals.score_grid(df, ["match_id"], -0.1)
    h, a, p = F.col("home_goals"), F.col("away_goals"), F.col("p")
    want = grid.groupBy("match_id").agg(*[(F.sum(F.when(c, p)) / F.sum(p)).alias(n) for n, c in (("p_away", h < a), ("p_draw", h == a), ("p_home", h > a))])
    got = goals.outcome_probs(df, -0.1).select("match_id", "p_away", "p_draw", "p_home")
    assert rows(got) == rows(want)
    total = got.select(F.max(F.abs(F.col("p_away") + F.col("p_draw") + F.col("p_home") - 1))).first()[0]
    assert total < 1e-12


def _team_tables(spark, alpha, beta, gamma, rho):
    teams = small_table(spark, [(0, t, float(a), float(b)) for t, (a, b) in enumerate(zip(alpha, beta))], "fit int, team int, alpha double, beta double")
    return teams, small_table(spark, [(0, float(gamma), float(rho))], "fit int, gamma double, rho double")


def test_goal_gradient_by_differences(spark, matches):
    sums = goals.pair_sums(matches, xi=0.001).cache()
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.2, 16), [0.2, -0.07]])

    def nll(v):
        return goals.goal_model_likelihood(sums, *_team_tables(spark, v[:8], v[8:16], v[16], v[17])).first().nll

    grad = np.zeros(18)
    for r in goals.goal_model_gradient(sums, *_team_tables(spark, x[:8], x[8:16], x[16], x[17])).collect():
        grad[r.team], grad[8 + r.team] = -r.da, -r.db
        grad[16] -= r.dg or 0
        grad[17] -= r.dr or 0
    for i in (0, 5, 11, 16, 17):
        step = np.zeros(18)
        step[i] = 1e-5
        assert abs((nll(x + step) - nll(x - step)) / 2e-5 - grad[i]) < 1e-3


def test_goal_fit_is_a_minimum(spark, matches):
    sums = goals.pair_sums(matches, xi=0.0).cache()
    model = goals.goal_model_fit(sums)
    best = goals.goal_model_likelihood(sums, model.teams, model.shared).first().nll
    assert abs(model.teams.agg(F.sum("alpha")).first()[0]) < 1e-9
    for shift in (0.02, -0.02):
        moved = model.shared.withColumn("gamma", F.col("gamma") + shift)
        assert goals.goal_model_likelihood(sums, model.teams, moved).first().nll > best


def test_folds_share_steps(spark, matches):
    """Fits of several folds, optimised together, equal a fit of one fold's matches."""
    sums = evaluate.fold_sums(matches, [2020, 2022], [0.001], min_year=2000)
    together = goals.goal_model_fit(sums)
    alone = goals.goal_model_fit(goals.pair_sums(matches.filter("year(date) < 2020"), xi=0.001, ref_date=F.lit("2020-01-01").cast("timestamp_ntz")))
    a = {r.team: r.alpha for r in together.teams.filter("fit = '2020|0.001'").collect()}
    b = {r.team: r.alpha for r in alone.teams.collect()}
    assert a.keys() == b.keys() and all(abs(a[t] - b[t]) < 2e-3 for t in a)


def test_regression_gradient_by_differences(spark, matches):
    frame = goals.regression_rows(matches, ["f", "g"], 0.001).cache()
    x = np.array([0.3, -0.2, 0.1, 0.25, 0.2, -0.06])

    def at(v):
        return goals.regression_params(spark, [0.8, 0.4], v[:2], v[2:4], v[4], v[5])

    r = goals.regression_sums(frame, at(x), 2).first()
    grad = -np.array([r.da0, r.da1, r.db0, r.db1, r.dg, r.dr])
    for i in range(6):
        step = np.zeros(6)
        step[i] = 1e-5
        up, down = (goals.goal_regression_likelihood(frame, at(x + s), 2).first().nll for s in (step, -step))
        assert abs((up - down) / 2e-5 - grad[i]) < 1e-3


def test_regression_at_rho_zero_is_a_poisson_glm(spark, matches):
    """With rho fixed at 0 the weights are those of a Poisson GLM on stacked sides without an intercept."""
    frame = goals.regression_rows(matches, ["f"], 0.0)
    mean = matches.select((F.avg("home_f") + F.avg("away_f")) / 2).first()[0]
    home = matches.select(F.col("home_score").alias("y"), (F.col("home_f") - mean).alias("a"), (mean - F.col("away_f")).alias("b"), F.lit(1.0).alias("g"))
    away = matches.select(F.col("away_score").alias("y"), (F.col("away_f") - mean).alias("a"), (mean - F.col("home_f")).alias("b"), F.lit(0.0).alias("g"))
    rows_ = VectorAssembler(inputCols=["a", "b", "g"], outputCol="x").transform(home.union(away))
    glm = GeneralizedLinearRegression(family="poisson", link="log", fitIntercept=False, featuresCol="x", labelCol="y", tol=1e-10).fit(rows_)
    a, b, g = glm.coefficients.toArray()
    r = goals.regression_sums(frame, goals.regression_params(spark, [mean], [a], [b], g, 0.0), 1).first()
    assert max(abs(r.da0), abs(r.db0), abs(r.dg)) < 1e-3


def test_optimiser_on_a_known_function():
    def f(x):
        return (1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2, np.array([-2 * (1 - x[0]) - 400 * x[0] * (x[1] - x[0] ** 2), 200 * (x[1] - x[0] ** 2)])

    run = goals.minimise(np.array([-1.2, 1.0]), tol=1e-16)
    point = next(run)
    while True:
        try:
            point = run.send(f(point))
        except StopIteration as stop:
            assert np.allclose(stop.value, [1, 1], atol=1e-4)
            break


def test_logit_probabilities(spark, matches):
    df = matches.withColumn("outcome", F.when(F.col("home_score") > F.col("away_score"), 2).when(F.col("home_score") == F.col("away_score"), 1).otherwise(0))
    model = outcome.feature_logit(df, ["home_f", "away_f"])
    scored = outcome.logit_predict(df, model)
    shares = scored.agg(*[F.avg(c) for c in outcome.TRIPLE]).first()
    actual = df.agg(*[F.avg((F.col("outcome") == i).cast("double")) for i in range(3)]).first()
    # an unpenalised intercept reproduces the class shares
    assert all(abs(a - b) < 1e-3 for a, b in zip(shares, actual))


def test_simplex():
    weights = outcome.simplex(3, 10)
    assert len(weights) == 66 and all(abs(sum(w) - 1) < 1e-12 for w in weights)
