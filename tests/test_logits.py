"""Logits of a grid against Spark ML, a plain optimiser's conditions, and their predictions."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from matchframe.operators import evaluate, logits
from matchframe.session import small_table


@pytest.fixture(scope="module")
def played():
    rng = np.random.default_rng(4)
    n = 600
    x = rng.normal(size=(n, 3)) * [1, 5, 0.1]
    z = np.stack([-x[:, 0], 0.2 * x[:, 1], x[:, 0] + x[:, 2]], axis=1) + rng.gumbel(size=(n, 3))
    years = rng.integers(2000, 2006, n)
    return [(int(i), int(years[i]), *[None if rng.random() < 0.1 and j else float(v) for j, v in enumerate(x[i])], int(z[i].argmax()), bool(i % 2)) for i in range(n)]


@pytest.fixture(scope="module")
def table(spark, played):
    return small_table(spark, played, "match_id long, year int, a double, b double, c double, outcome int, odd boolean").cache()


def ml_fit(df, features, c=1.0):
    rows = df.na.drop(subset=features).withColumn("label", F.col("outcome").cast("double"))
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    fitted = LogisticRegression(family="multinomial", regParam=1 / (c * rows.count()), standardization=False, maxIter=500, tol=1e-14).fit(rows)
    return fitted.interceptVector.toArray(), fitted.coefficientMatrix.toArray()


@pytest.mark.parametrize(("features", "c"), [(["a"], 1.0), (["a", "b", "c"], 1.0), (["b", "c"], 0.01)])
def test_coefficients_are_those_of_spark_ml(table, features, c):
    model = logits.feature_logit(table, features, c=c)
    intercepts, weights = ml_fit(table, features, c)
    assert np.abs(np.array(model.intercepts) - intercepts).max() < 1e-6 and np.abs(np.array(model.weights) - weights).max() < 1e-6


FITS = [
    logits.Fit("a", ("a",), 2003), logits.Fit("a", ("a",), 2005), logits.Fit("all", ("a", "b", "c"), 2004), logits.Fit("odd", ("a", "b"), 2005, only="odd"),
    logits.Fit("zero", ("a", "b", "c"), 2005, fill="zero", fill_cols=("b", "c")), logits.Fit("mean", ("c", "a", "b"), 2003, fill="mean", fill_cols=("b",)),
    logits.Fit("none", ("a",), 2000), logits.Fit("few", ("a",), 2001, only="match_id < 40"),
]


def plain_rows(played, fit):
    """Training matrix and outcomes of one fit, the plain way."""
    names = {"a": 2, "b": 3, "c": 4}
    own = [r for r in played if r[1] < fit.fold and (fit.only is None or (r[6] if fit.only == "odd" else r[0] < 40))]
    fills = {}
    for c in fit.fill_cols:
        known = [r[names[c]] for r in own if r[names[c]] is not None]
        fills[c] = 0.0 if fit.fill == "zero" else sum(known) / len(known)
    x = [[r[names[c]] if r[names[c]] is not None else fills.get(c) for c in fit.features] for r in own]
    kept = [k for k, v in enumerate(x) if None not in v]
    return np.array([[1.0, *x[k]] for k in kept]), np.array([own[k][5] for k in kept]), fills


def test_all_fits_reach_their_optimum_together(table, played):
    grid = logits.fit_grid(table, FITS, at="year", least=20)
    assert grid.steps < 15  # jobs for all fits, however many there are
    for fit, model, size in zip(grid.fits, grid.models, grid.sizes, strict=True):
        if fit.config == "none":
            assert (model, size) == (None, 0)
            continue
        x, y, _ = plain_rows(played, fit)
        assert size == len(y)
        if len(y) < 20:
            assert model is None
            continue
        w = np.array([[i, *v] for i, v in zip(model.intercepts, model.weights, strict=True)])
        z = x @ w.T
        p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        gradient = (p - np.eye(3)[y]).T @ x
        gradient[:, 1:] += w[:, 1:]
        assert np.abs(gradient).max() / len(y) < 1e-6 and abs(sum(model.intercepts)) < 1e-9


def test_gradient_of_the_likelihood_vanishes_at_the_fit(table):
    grid = logits.fit_grid(table, FITS, at="year", least=20)
    found = logits.likelihood(table, grid, at="year").collect()
    assert {r.config for r in found} >= {"a", "all", "odd", "zero", "mean"} and all(abs(r.gradient) / r.n < 1e-6 for r in found)


def test_predictions_fill_and_leave_out_like_training(spark, table, played):
    grid = logits.fit_grid(table, FITS, at="year", least=20)
    tests = table.withColumn("fold", F.col("year"))
    got = {(r.config, r.match_id): (r.p_away, r.p_draw, r.p_home) for r in logits.grid_predict(tests, grid).collect()}
    want = {}
    for fit, model in zip(grid.fits, grid.models, strict=True):
        if model is None:
            continue
        fills = plain_rows(played, fit)[2]
        for r in played:
            x = [v if (v := r[{"a": 2, "b": 3, "c": 4}[c]]) is not None else fills.get(c) for c in fit.features]
            if r[1] == fit.fold and None not in x:
                z = [i + sum(a * b for a, b in zip(w, x, strict=True)) for i, w in zip(model.intercepts, model.weights, strict=True)]
                e = np.exp(np.array(z) - max(z))
                want[fit.config, r[0]] = tuple(e / e.sum())
    assert got.keys() == want.keys() and all(np.abs(np.array(got[k]) - want[k]).max() < 1e-9 for k in want)


def test_classes_and_rows_that_are_missing(spark):
    two = small_table(spark, [(float(k), k % 2 * 2, 1) for k in range(40)] + [(None, 1, 1), (3.0, None, 1)], "x double, outcome int, fold int")
    model = logits.feature_logit(two, ["x"])
    p = logits.logit_predict(two.where("x is not null"), model).collect()
    assert all(r.p_draw < 1e-12 and abs(r.p_away + r.p_home - 1) < 1e-12 for r in p)
    one = small_table(spark, [(float(k), 2) for k in range(5)], "x double, outcome int")
    assert all(r.p_home == 1.0 for r in logits.logit_predict(one, logits.feature_logit(one, ["x"])).collect())
    with pytest.raises(ValueError, match="no row"):
        logits.feature_logit(one.limit(0), ["x"])


def test_short_folds_come_back_with_a_reason(spark, table):
    day = F.make_date("year", F.lit(6), F.lit(1)).cast("timestamp_ntz")
    rows = table.withColumns({"date": day, "tournament": F.lit("cup")})
    predicted, folds = evaluate.ablation(rows, {"one": {"features": ["a"]}, "filled": {"features": ["a", "b"], "fill": "mean", "fill_cols": ["b"]}}, [2000, 2001, 2004], label="cup", min_train=150)
    reasons = {(r.config, r.fold): (r.n_train, r.reason) for r in folds.collect()}
    assert reasons["one", 2000] == (0, "fewer than 150 training rows") and reasons["one", 2004][1] is None and reasons["one", 2001][1] is not None
    assert {(r.config, r.fold) for r in predicted.select("config", "fold").distinct().collect()} == {k for k, v in reasons.items() if v[1] is None}


def test_plans_that_share_their_rows_have_the_sums_of_each_alone():
    rng = np.random.default_rng(3)
    x, y = np.concatenate([np.ones((1, 400)), rng.normal(size=(3, 400))]), rng.integers(0, 3, 400)
    own, w = rng.random((5, 400)) < 0.6, rng.normal(size=(5, 3, 4))
    for mask, c, found in zip(own, w, logits._sums_of(x, y, own, w), strict=True):
        z = c @ x[:, mask]
        p = np.exp(z) / np.exp(z).sum(axis=0)
        truth = np.eye(3)[y[mask]].T
        hessian = np.einsum("an,ac,in,jn->aicj", p, np.eye(3), x[:, mask], x[:, mask]) - np.einsum("an,cn,in,jn->aicj", p, p, x[:, mask], x[:, mask])
        plain = np.concatenate([[-(truth * np.log(p)).sum()], truth.sum(axis=1), ((p - truth) @ x[:, mask].T).ravel(), hessian.ravel()])
        assert np.allclose(found, plain, rtol=1e-9, atol=1e-9)
