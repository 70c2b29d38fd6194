"""The goal model's steps over tables against the same steps over vectors on the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchframe.operators import goals
from matchframe.session import small_table


@pytest.fixture(scope="module")
def sums(spark):
    """Two fits with teams of their own, one of them with a team that never scores."""
    rng = np.random.default_rng(7)
    rows = []
    for fit, n in (("x", 12), ("y", 5)):
        strength = rng.normal(0, 0.4, (n, 2))
        for k in range(60 * n):
            i, j = rng.choice(n, 2, replace=False)
            hg, ag = rng.poisson(np.exp(strength[i, 0] - strength[j, 1] + 0.2)), rng.poisson(np.exp(strength[j, 0] - strength[i, 1]))
            w = float(rng.uniform(0.2, 1))
            cell = f"{hg}{ag}" if hg <= 1 and ag <= 1 else ""
            rows.append((fit, int(i), int(j), cell, w, w * hg, w * ag))
    df = small_table(spark, rows, "fit string, home int, away int, cell string, w double, wh double, wa double")
    return df.groupBy("fit", "home", "away", "cell").agg(*[F.sum(c).alias(c) for c in ("w", "wh", "wa")]).cache()


def on_the_driver(rows):
    """(alpha, beta, gamma, rho) by the driver's own steps."""
    teams = sorted({r.home for r in rows} | {r.away for r in rows})
    n = len(teams)
    h, a = (np.array([teams.index(getattr(r, s)) for r in rows]) for s in ("home", "away"))
    w, wh, wa = (np.array([getattr(r, c) for r in rows]) for c in ("w", "wh", "wa"))
    cell = np.array([r.cell for r in rows])

    def at(x):
        alpha, beta = x[:n] - x[:n].mean(), x[n : 2 * n] - x[n : 2 * n].mean()
        gamma, rho = x[-2:]
        llh, lla = alpha[h] - beta[a] + gamma, alpha[a] - beta[h]
        lh, la = np.exp(llh), np.exp(lla)
        tau = np.select([cell == "00", cell == "01", cell == "10", cell == "11"], [1 - lh * la * rho, 1 + lh * rho, 1 + la * rho, 1 - rho], 1.0)
        if (tau <= 0).any():
            return goals.INVALID, np.zeros_like(x)
        zero = np.zeros_like(lh)
        dh = np.select([cell == "00", cell == "01"], [-lh * la * rho / tau, lh * rho / tau], zero)
        da = np.select([cell == "00", cell == "10"], [-lh * la * rho / tau, la * rho / tau], zero)
        dr = np.select([cell == "00", cell == "01", cell == "10", cell == "11"], [-lh * la / tau, lh / tau, la / tau, -1 / tau], zero)
        ch, ca = wh - w * lh + w * dh, wa - w * la + w * da
        g = np.concatenate([np.bincount(h, ch, n) + np.bincount(a, ca, n), -np.bincount(a, ch, n) - np.bincount(h, ca, n), [ch.sum(), (w * dr).sum()]])
        g[:n] -= g[:n].mean()
        g[n : 2 * n] -= g[n : 2 * n].mean()
        return -(wh * llh - w * lh + wa * lla - w * la + w * np.log(tau)).sum(), -g

    x = np.zeros(2 * n + 2)
    x[-2:] = goals.START_GAMMA, goals.START_RHO
    run = goals.minimise(x, tol=1e-14)
    point = next(run)
    while True:
        try:
            point = run.send(at(point))
        except StopIteration as stop:
            x = stop.value
            return {t: (x[k] - x[:n].mean(), x[n + k] - x[n : 2 * n].mean()) for k, t in enumerate(teams)}, x[-2:]


@pytest.mark.parametrize("memory", [4])
def test_tables_reach_the_same_optimum(sums, memory):
    model = goals.goal_model_fit(sums, memory=memory, tol=1e-14)
    found = {(r.fit, r.team): (r.alpha, r.beta) for r in model.teams.collect()}
    ends = {r.fit: (r.gamma, r.rho) for r in model.shared.collect()}
    for fit in ("x", "y"):
        want, shared = on_the_driver(sums.where(F.col("fit") == fit).collect())
        assert {t for f, t in found if f == fit} == set(want)
        assert max(np.abs(np.array(found[fit, t]) - want[t]).max() for t in want) < 1e-6 and np.abs(np.array(ends[fit]) - shared).max() < 1e-6
        assert abs(sum(found[fit, t][0] for t in want)) < 1e-9 and abs(sum(found[fit, t][1] for t in want)) < 1e-9


def test_driver_holds_a_few_numbers_a_fit():
    climb = goals.Climb(10, 1e-9, 100)
    assert climb.gram.size + climb.sums.size + climb.ends.size < 800


def test_no_matches(spark, sums):
    model = goals.goal_model_fit(sums.limit(0))
    assert model.teams.collect() == [] and model.shared.collect() == []
