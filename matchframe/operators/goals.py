"""Goal models: two Poisson rates per match with a correction of the four lowest scores.

Fitting never gathers matches. A step of the optimiser is one aggregate: the current parameters (a model-sized
table) are joined to the data and value and gradient are summed. For team strengths the data of all steps is first
reduced, once, to weight and goal sums per (fit, home, away, low-score cell), so steps do not depend on the number
of matches. Any number of fits (walk-forward folds, decay rates) shares every step.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchframe.functions.dates import decay_weight, floor_days
from matchframe.session import durable, small_table, written

START_GAMMA, START_RHO = 0.25, -0.10
INVALID = 1e10
MAX_STEPS = 500


# --- score grid -----------------------------------------------------------------------------------------------


def poisson_terms(lam: Column, top: int = 10) -> list[Column]:
    """P(0) .. P(top), each from the one before it."""
    terms = [F.exp(-lam)]
    for k in range(1, top + 1):
        terms.append(terms[-1] * lam / k)
    return terms


def low_score_factor(h: Column, a: Column, lam_h: Column, lam_a: Column, rho: Column) -> Column:
    return (
        F.when((h == 0) & (a == 0), 1 - lam_h * lam_a * rho)
        .when((h == 0) & (a == 1), 1 + lam_h * rho)
        .when((h == 1) & (a == 0), 1 + lam_a * rho)
        .when((h == 1) & (a == 1), 1 - rho)
        .otherwise(1.0)
    )


def _rho(rho: Column | float) -> Column:
    return rho if isinstance(rho, Column) else F.lit(float(rho))


def score_grid(df: DataFrame, keys: list[str], rho: Column | float, lam_h: str = "lam_home", lam_a: str = "lam_away", top: int = 10):
    """(keys, home_goals, away_goals, p) for all (top + 1)^2 cells of each match, not renormalised. No join."""
    pmf = df.select(
        *keys, F.col(lam_h).alias("_lh"), F.col(lam_a).alias("_la"), _rho(rho).alias("_rho"),
        F.array(*poisson_terms(F.col(lam_h), top)).alias("_ph"), F.array(*poisson_terms(F.col(lam_a), top)).alias("_pa"),
    )
    cells = pmf.select("*", F.posexplode("_ph").alias("home_goals", "_p")).select("*", F.posexplode("_pa").alias("away_goals", "_q"))
    factor = low_score_factor(F.col("home_goals"), F.col("away_goals"), F.col("_lh"), F.col("_la"), F.col("_rho"))
    return cells.select(*keys, "home_goals", "away_goals", (F.col("_p") * F.col("_q") * factor).alias("p"))


def outcome_probs(
    df: DataFrame, rho: Column | float, lam_h: str = "lam_home", lam_a: str = "lam_away", top: int = 10,
    names: tuple[str, str, str] = ("p_away", "p_draw", "p_home"),
) -> DataFrame:
    """Three outcome probabilities of each match: sums over the grid, divided by its total.

    Written out as arithmetic on 2 * (top + 1) columns, so nothing is exploded or shuffled and it stays in one
    generated stage.
    """
    lh, la, r = F.col(lam_h), F.col(lam_a), F.col("_rho")
    staged = df.withColumn("_rho", _rho(rho)).withColumns(
        {f"_h{k}": t for k, t in enumerate(poisson_terms(lh, top))} | {f"_a{k}": t for k, t in enumerate(poisson_terms(la, top))}
    )
    h, a = ([F.col(f"_{s}{k}") for k in range(top + 1)] for s in "ha")

    def total(terms: list[Column]) -> Column:
        out = terms[0]
        for t in terms[1:]:
            out = out + t
        return out

    def below(p: list[Column], q: list[Column]) -> Column:
        return total([p[k] * total(q[:k]) for k in range(1, top + 1)])

    p00, p01, p10, p11 = h[0] * a[0], h[0] * a[1], h[1] * a[0], h[1] * a[1]
    summed = staged.withColumns(
        {
            "_home": below(h, a) + p10 * la * r,
            "_away": below(a, h) + p01 * lh * r,
            "_draw": total([h[k] * a[k] for k in range(top + 1)]) - p00 * lh * la * r - p11 * r,
        }
    )
    whole = F.col("_home") + F.col("_draw") + F.col("_away")
    away, draw, home = names
    return summed.withColumns({away: F.col("_away") / whole, draw: F.col("_draw") / whole, home: F.col("_home") / whole}).drop(
        "_rho", "_home", "_away", "_draw", *[f"_{s}{k}" for s in "ha" for k in range(top + 1)]
    )


def knockout_chance(df: DataFrame, lam_h: str, lam_a: str, share: float = 1 / 3, top: int = 10, name: str = "p_through") -> DataFrame:
    """``df`` with the home side's chance to win a match that must have a winner, from p_home and p_draw.

    After a draw comes extra time at ``share`` of both rates, then a coin.
    """
    both = F.zip_with(F.array(*poisson_terms(F.col(lam_h) * share, top)), F.array(*poisson_terms(F.col(lam_a) * share, top)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    names = ("ahead", "level", "behind", "above", "below")  # chances so far, and of fewer goals of either side
    start = F.struct(*[F.lit(0.0).alias(n) for n in names])

    def goals_of(so_far: Column, x: Column) -> Column:
        steps = (x["p"] * so_far["below"], x["p"] * x["q"], x["q"] * so_far["above"], x["p"], x["q"])
        return F.struct(*[(so_far[n] + step).alias(n) for n, step in zip(names, steps)])

    extra = df.withColumn("_extra", both).withColumn("_extra", F.aggregate("_extra", start, goals_of))
    total = F.col("_extra.ahead") + F.col("_extra.level") + F.col("_extra.behind")
    return extra.withColumn(name, F.col("p_home") + F.col("p_draw") * (F.col("_extra.ahead") + F.col("_extra.level") / 2) / total).drop("_extra")


def most_likely_score(df: DataFrame, rho: Column | float, lam_h: str = "lam_home", lam_a: str = "lam_away", top: int = 10):
    """Most probable cell of each match's grid as "h-a" (the first in row order on a tie) and its share of the grid."""
    lh, la, r = F.col(lam_h), F.col(lam_a), F.col("_rho")
    staged = df.withColumns(
        {"_rho": _rho(rho), "_ph": F.array(*poisson_terms(lh, top)), "_pa": F.array(*poisson_terms(la, top))}
    )

    def peak(terms: str, first: int) -> Column:
        """(index, probability) of the largest term from ``first`` on, the earliest of equal ones."""
        rounded = F.transform(F.slice(terms, first + 1, top + 1 - first), lambda p: F.rint(p * 1e13))
        index = F.array_position(rounded, F.array_max(rounded)).cast("int") - 1 + first
        return F.struct(index.alias("i"), F.get(terms, index).alias("p"))

    peaks = staged.withColumns({"_h2": peak("_ph", 2), "_a0": peak("_pa", 0), "_a2": peak("_pa", 2)})
    h, a, zero, one = (lambda k: F.col("_ph")[k]), (lambda k: F.col("_pa")[k]), F.lit(0), F.lit(1)
    corrected = {"00": -lh * la * r, "01": lh * r, "10": la * r, "11": -r}

    def cell(p: Column, i: Column, j: Column) -> Column:
        # 0-0 and 1-1 tie wherever lh * la is 1; rounding keeps that a tie.
        return F.struct(F.rint(p * 1e12).alias("at"), (-i).alias("h"), (-j).alias("a"), p.alias("p"))

    # Away from the four corrected cells the grid is a product, so only its peaks can win.
    low = [cell(h(int(c[0])) * a(int(c[1])) * (1 + x), F.lit(int(c[0])), F.lit(int(c[1]))) for c, x in corrected.items()]
    far, away, home = F.col("_a2"), F.col("_a0"), F.col("_h2")
    rest = [
        cell(h(0) * far["p"], zero, far["i"]), cell(h(1) * far["p"], one, far["i"]), cell(home["p"] * away["p"], home["i"], away["i"])
    ]

    def total(terms: str) -> Column:
        return F.aggregate(terms, F.lit(0.0), lambda acc, p: acc + p)

    extra = F.lit(0.0)
    for c, x in corrected.items():
        extra = extra + h(int(c[0])) * a(int(c[1])) * x
    best = peaks.withColumns({"_best": F.array_max(F.array(*low, *rest)), "_total": total("_ph") * total("_pa") + extra})
    return best.withColumns(
        {
            "most_likely_score": F.concat_ws("-", -F.col("_best.h"), -F.col("_best.a")),
            "most_likely_p": F.col("_best.p") / F.col("_total"),
        }
    ).drop("_rho", "_ph", "_pa", "_h2", "_a0", "_a2", "_best", "_total")


def independent_poisson_probs(df: DataFrame, lam_h: str = "exp_home_goals", lam_a: str = "exp_away_goals", top: int = 10):
    return outcome_probs(df, 0.0, lam_h, lam_a, top)


# --- likelihood -----------------------------------------------------------------------------------------------


def _tau_parts(lh: Column, la: Column, rho: Column) -> dict[str, Column]:
    """tau and the derivatives of log tau by log rate (home, away) and by rho, by the ``cell`` column."""
    c = F.col("cell")
    tau = F.when(c == "00", 1 - lh * la * rho).when(c == "01", 1 + lh * rho).when(c == "10", 1 + la * rho).when(c == "11", 1 - rho).otherwise(1.0)
    return {
        "tau": tau,
        "dh": F.when(c == "00", -lh * la * rho / tau).when(c == "01", lh * rho / tau).otherwise(0.0),
        "da": F.when(c == "00", -lh * la * rho / tau).when(c == "10", la * rho / tau).otherwise(0.0),
        "dr": F.when(c == "00", -lh * la / tau).when(c == "01", lh / tau).when(c == "10", la / tau).when(c == "11", -1 / tau).otherwise(0.0),
    }


def _cell(hg: Column, ag: Column) -> Column:
    return F.when((hg <= 1) & (ag <= 1), F.concat(hg.cast("int").cast("string"), ag.cast("int").cast("string"))).otherwise("")


def _with_terms(df: DataFrame) -> DataFrame:
    """Log-likelihood and its derivatives of rows with w, wh, wa (weight and weighted goals), llh, lla, rho, cell."""
    rated = df.withColumns({"lh": F.exp("llh"), "la": F.exp("lla")})
    parts = rated.withColumns({f"_{n}": c for n, c in _tau_parts(F.col("lh"), F.col("la"), F.col("rho")).items()})
    bad = F.col("_tau") <= 0
    value = F.col("wh") * F.col("llh") - F.col("w") * F.col("lh") + F.col("wa") * F.col("lla") - F.col("w") * F.col("la")
    return parts.withColumns(
        {
            "bad": bad.cast("int"),
            "ll": F.when(bad, 0.0).otherwise(value + F.col("w") * F.ln("_tau")),
            "ch": F.when(bad, 0.0).otherwise(F.col("wh") - F.col("w") * F.col("lh") + F.col("w") * F.col("_dh")),
            "ca": F.when(bad, 0.0).otherwise(F.col("wa") - F.col("w") * F.col("la") + F.col("w") * F.col("_da")),
            "cr": F.when(bad, 0.0).otherwise(F.col("w") * F.col("_dr")),
        }
    )


def pair_sums(matches: DataFrame, fit: str | None = None, xi: float | Column = 0.0018, ref_date: Column | None = None) -> DataFrame:
    """(fit, home, away, cell, w, wh, wa): all the data a team-strength fit needs, in one map-side combined aggregate.

    Weights decay from ``ref_date`` (the newest date of the data unless given).
    """
    played = matches.filter(F.col("home_score").isNotNull() & F.col("away_score").isNotNull())
    reference = played.select(F.max("date")).scalar() if ref_date is None else ref_date
    if isinstance(xi, Column):  # a rate per fit
        weight = F.exp(-xi * floor_days(F.col("date"), reference))
    else:
        weight = decay_weight(F.col("date"), reference, xi)
    hg, ag = F.col("home_score"), F.col("away_score")
    return played.groupBy(
        (F.lit(0) if fit is None else F.col(fit)).alias("fit"), F.col("home_team").alias("home"), F.col("away_team").alias("away"),
        _cell(hg, ag).alias("cell"),
    ).agg(F.sum(weight).alias("w"), F.sum(weight * hg).alias("wh"), F.sum(weight * ag).alias("wa"))


def _team_terms(sums: DataFrame, params: DataFrame, shared: DataFrame) -> DataFrame:
    """Pair sums with both teams' strengths and the fit's gamma and rho (which come with the home team's)."""
    strengths = params.join(shared, "fit")
    home = strengths.select("fit", F.col("team").alias("home"), F.col("alpha").alias("ah"), F.col("beta").alias("bh"), "gamma", "rho")
    away = params.select("fit", F.col("team").alias("away"), F.col("alpha").alias("aa"), F.col("beta").alias("ba"))
    joined = sums.join(home, ["fit", "home"]).join(away, ["fit", "away"])
    return _with_terms(
        joined.withColumns({"llh": F.col("ah") - F.col("ba") + F.col("gamma"), "lla": F.col("aa") - F.col("bh")})
    )


def goal_model_likelihood(sums: DataFrame, params: DataFrame, shared: DataFrame) -> DataFrame:
    """(fit, nll) at given strengths (fit, team, alpha, beta) and (fit, gamma, rho); a large penalty if tau <= 0 anywhere."""
    terms = _team_terms(sums, params, shared).groupBy("fit").agg(F.max("bad").alias("_bad"), F.sum("ll").alias("_ll"))
    return terms.select("fit", F.when(F.col("_bad") > 0, INVALID).otherwise(-F.col("_ll")).alias("nll"))


def goal_model_gradient(sums: DataFrame, params: DataFrame, shared: DataFrame) -> DataFrame:
    """Sums per (fit, team): d alpha, d beta, and the home side's share of the value, d gamma and d rho."""
    terms = _team_terms(sums, params, shared).select(
        "fit", "bad", "ll", "cr",
        F.explode(
            F.array(
                F.struct(F.col("home").alias("team"), F.col("ch").alias("da"), (-F.col("ca")).alias("db"), F.lit(1).alias("home")),
                F.struct(F.col("away").alias("team"), F.col("ca").alias("da"), (-F.col("ch")).alias("db"), F.lit(0).alias("home")),
            )
        ).alias("_t"),
    ).select("fit", "bad", "ll", "cr", "_t.*")
    once = F.col("home") == 1  # value, gamma and rho count once per row, not once per side
    return terms.groupBy("fit", "team").agg(
        F.sum("da").alias("da"), F.sum("db").alias("db"), F.max("bad").alias("bad"),
        F.sum(F.when(once, F.col("ll"))).alias("ll"), F.sum(F.when(once, F.col("da"))).alias("dg"),
        F.sum(F.when(once, F.col("cr"))).alias("dr"),
    )


# --- optimiser ------------------------------------------------------------------------------------------------


def minimise(x: np.ndarray, steps: int = MAX_STEPS, memory: int = 10, tol: float = 1e-9) -> Iterator[np.ndarray]:
    """Limited-memory quasi-Newton steps as a generator: yields a point, is sent (value, gradient), returns the best point."""
    value, grad = yield x
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.max(np.abs(grad)) < 1e-5:
            break
        q, alphas = grad.copy(), []
        for s, y in reversed(pairs):
            a = s @ q / (y @ s)
            alphas.append(a)
            q -= a * y
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, np.linalg.norm(grad))
        for (s, y), a in zip(pairs, reversed(alphas)):
            q += s * (a - (y @ q) / (y @ s))
        direction, slope, t = -q, -(grad @ q), 1.0
        if slope >= 0:
            pairs, direction, slope = [], -grad, -(grad @ grad)
        while True:
            candidate = x + t * direction
            new_value, new_grad = yield candidate
            if new_value <= value + 1e-4 * t * slope:
                break
            t *= 0.5
            if t < 1e-12:
                return x
        s, y = candidate - x, new_grad - grad
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        done = value - new_value <= tol * max(abs(value), abs(new_value), 1.0)
        x, value, grad = candidate, new_value, new_grad
        if done:
            break
    return x


def _lockstep(starts: dict, evaluate) -> dict:
    """Run one optimiser per fit; every round evaluates the points of all unfinished fits in one Spark job."""
    runs = {f: minimise(x) for f, x in starts.items()}
    points, found = {f: next(run) for f, run in runs.items()}, {}
    while points:
        answers = evaluate(points)
        following = {}
        for f in points:
            try:
                following[f] = runs[f].send(answers[f])
            except StopIteration as stop:
                found[f] = stop.value
        points = following
    return found


@dataclass
class GoalModel:
    """Fitted strengths: ``teams`` (fit, team, alpha, beta) and ``shared`` (fit, gamma, rho) tables."""

    teams: DataFrame
    shared: DataFrame


class Climb:
    """Limited-memory quasi-Newton steps over vectors that only Spark sees.

    A vector is a list of coefficients over basis vectors, the points and gradients that are held as ``slots`` columns of
    a table; the driver knows the products of the basis vectors with each other, their sums, and their last two
    components (gamma and rho). That is all the two-loop recursion needs. The rest of a vector is centred: both halves of
    it (attack and defense) have mean 0.
    """

    def __init__(self, memory: int, tol: float, steps: int):
        self.memory, self.tol, self.left = memory, tol, steps
        self.slots = 2 * (memory + 2)
        self.gram = np.zeros((self.slots, self.slots))
        self.sums = np.zeros((self.slots, 2))  # of the attack and the defense half of every basis vector
        self.ends = np.zeros((self.slots, 2))
        self.teams = 1
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.x = np.zeros(self.slots)
        self.grad: np.ndarray | None = None
        self.value, self.slope, self.t = math.inf, 0.0, 1.0
        self.direction = np.zeros(self.slots)
        self.start = np.array([START_GAMMA, START_RHO])
        self.done = False
        self.choose()

    def dot(self, u: np.ndarray, v: np.ndarray) -> float:
        centred = self.gram - self.sums @ self.sums.T / self.teams
        return float(u @ (centred + self.ends @ self.ends.T) @ v)

    def choose(self) -> None:
        """Slots for the next point and its gradient."""
        used = [self.x, *([] if self.grad is None else [self.grad]), *[v for pair in self.pairs for v in pair]]
        free = [k for k in range(self.slots) if not any(v[k] for v in used)]
        self.at = free[0], free[1]

    def candidate(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(coefficients, means to take off both halves, gamma and rho) of the next point."""
        c = self.x + self.t * self.direction
        return c, c @ self.sums / self.teams, c @ self.ends + (self.start if self.grad is None else 0)

    def told(self, value: float, products: np.ndarray, sums: np.ndarray, teams: int, ends: np.ndarray) -> None:
        """``products`` of the new point and of its gradient with all slots, the new ones in them; ``sums`` and ``ends`` of the gradient."""
        point, slope = self.at
        _, _, own = self.candidate()
        if self.grad is not None and not value <= self.value + 1e-4 * self.t * self.slope:
            self.t *= 0.5
            self.done = self.t < 1e-12
            return
        self.teams = teams
        for k, row in ((point, products[0]), (slope, products[1])):
            self.gram[k], self.gram[:, k] = row, row
        self.sums[point], self.sums[slope] = 0, sums
        self.ends[point], self.ends[slope] = own, ends
        x, grad = np.eye(self.slots)[point], np.eye(self.slots)[slope]
        if self.grad is not None:
            s, y = x - self.x, grad - self.grad
            if self.dot(s, y) > 1e-12:
                self.pairs = [*self.pairs, (s, y)][-self.memory :]
            self.done = self.value - value <= self.tol * max(abs(self.value), abs(value), 1.0)
        self.x, self.grad, self.value, self.t = x, grad, value, 1.0
        self.left -= 1
        size = math.sqrt(max(0.0, self.dot(grad, grad)))
        if self.done or size < 1e-5 or self.left < 0:
            self.done = True
            return
        q, alphas = grad.copy(), []
        for s, y in reversed(self.pairs):
            a = self.dot(s, q) / self.dot(y, s)
            alphas.append(a)
            q = q - a * y
        if self.pairs:
            s, y = self.pairs[-1]
            q = q * (self.dot(s, y) / self.dot(y, y))
        else:
            q = q / max(1.0, size)
        for (s, y), a in zip(self.pairs, reversed(alphas)):
            q = q + s * (a - self.dot(y, q) / self.dot(y, s))
        self.direction, self.slope = -q, -self.dot(grad, q)
        if self.slope >= 0:
            self.pairs, self.direction, self.slope = [], -grad, -size * size
        self.choose()


def goal_model_fit(sums: DataFrame, memory: int = 10, tol: float = 1e-9, steps: int = MAX_STEPS) -> GoalModel:
    """Fit all fits of ``pair_sums``. Strengths are centred, start at 0; gamma and rho start at 0.25 and -0.10.

    Strengths, gradients and the optimiser's memory are columns of a table (fit, team); each evaluation joins it to the
    data, adds a point and its gradient, and writes it. All fits are evaluated together. The driver holds the products
    of these columns, a few hundred numbers per fit, however many teams there are.
    """
    spark = sums.sparkSession
    data = written(sums)
    teams = data.select("fit", F.explode(F.array("home", "away")).alias("team")).distinct()
    fit_type = teams.schema["fit"].dataType.simpleString()
    open_ = {r["fit"]: Climb(memory, tol, steps) for r in teams.select("fit").distinct().collect()}
    slots = 2 * (memory + 2)
    state = written(teams.select("fit", "team", *[F.array_repeat(F.lit(0.0), slots).alias(c) for c in ("a", "b")]))
    fitted, shared = [], []

    def combined(half: str) -> Column:
        return F.aggregate(F.zip_with(half, "c", lambda v, w: v * w), F.lit(0.0), lambda x, y: x + y) - F.col(f"off_{half}")

    def points(of: dict) -> tuple[DataFrame, list]:
        """``state`` of the fits with their point as alpha and beta, and rows (fit, gamma, rho)."""
        rows, ends = [], []
        for f, climb in of.items():
            c, off, (gamma, rho) = climb.candidate()
            rows.append((f, c.tolist(), float(off[0]), float(off[1]), *climb.at))
            ends.append((f, float(gamma), float(rho)))
        plan = small_table(spark, rows, f"fit {fit_type}, c array<double>, off_a double, off_b double, point int, slope int")
        return state.select("fit", "team", "a", "b").join(plan, "fit").withColumns({"alpha": combined("a"), "beta": combined("b")}), ends

    while open_:
        at, ends = points(open_)
        now = small_table(spark, ends, f"fit {fit_type}, gamma double, rho double")
        found = goal_model_gradient(data.where(F.col("fit").isin(list(open_))), at.select("fit", "team", "alpha", "beta"), now)
        held = at.join(found.withColumns({"ga": -F.col("da"), "gb": -F.col("db")}), ["fit", "team"])

        def entered(half: str, value: str, gradient: str) -> Column:
            return F.transform(half, lambda v, k: F.when(k == F.col("point"), F.col(value)).when(k == F.col("slope"), F.col(gradient)).otherwise(v))

        state = written(
            held.select("fit", "team", entered("a", "alpha", "ga").alias("a"), entered("b", "beta", "gb").alias("b"), "alpha", "beta", "ga", "gb", "ll", "bad", "dg", "dr")
        )
        products = [
            F.sum(F.col("a")[k] * F.col(x) + F.col("b")[k] * F.col(y)).alias(f"{n}{k}") for n, x, y in (("x", "alpha", "beta"), ("g", "ga", "gb")) for k in range(slots)
        ]
        totals = [F.count(F.lit(1)).alias("n"), F.max("bad").alias("bad"), *[F.sum(c).alias(f"s_{c}") for c in ("ll", "dg", "dr", "ga", "gb")]]
        for r in state.groupBy("fit").agg(*totals, *products).collect():
            climb = open_[r["fit"]]
            if r["bad"]:
                climb.told(INVALID, np.zeros((2, slots)), np.zeros(2), r["n"], np.zeros(2))
            else:
                along = np.array([[r[f"{n}{k}"] for k in range(slots)] for n in "xg"])
                climb.told(-r["s_ll"], along, np.array([r["s_ga"], r["s_gb"]]), r["n"], -np.array([r["s_dg"] or 0.0, r["s_dr"] or 0.0]))
        done = {f: climb for f, climb in open_.items() if climb.done}
        if done:
            for climb in done.values():
                climb.t = 0.0  # the best point itself
            best, ends = points(done)
            fitted.append(best.select("fit", "team", "alpha", "beta"))
            shared += ends
            open_ = {f: climb for f, climb in open_.items() if f not in done}
    if not fitted:
        fitted = [teams.select("fit", "team", F.lit(0.0).alias("alpha"), F.lit(0.0).alias("beta"))]
    return GoalModel(reduce(DataFrame.unionByName, fitted), small_table(spark, shared, f"fit {fit_type}, gamma double, rho double"))


def params_table(model: GoalModel) -> DataFrame:
    return model.teams.select(
        "fit", "team", F.col("alpha").alias("attack"), F.col("beta").alias("defense"), (F.col("alpha") + F.col("beta")).alias("total")
    ).orderBy("fit", F.desc("total"), "team")


def predict_rates(matches: DataFrame, teams: DataFrame, shared: DataFrame, fit: str | None = None, neutral_default: bool = False):
    """lam_home, lam_away and rho of each match; an unknown team has strength 0, a neutral match no home advantage."""
    out = matches
    for side in ("home", "away"):
        part = teams.select(F.col("fit").alias("_f"), F.col("team").alias("_t"), F.col("alpha").alias("_a"), F.col("beta").alias("_b"))
        same = out[f"{side}_team"] == part["_t"]
        joined = out.join(part, same if fit is None else same & (out[fit] == part["_f"]), "left").drop("_f", "_t")
        out = joined.withColumnsRenamed({"_a": f"_{side}_a", "_b": f"_{side}_b"})
    if fit is None:  # one fit: its two numbers are a scalar subquery
        one = F.col("_shared")
        out = out.withColumn("_shared", shared.select(F.struct("gamma", "rho")).scalar())
        out = out.withColumns({"_gamma": one["gamma"], "rho": one["rho"]}).drop("_shared")
    else:
        both = shared.select(F.col("fit").alias("_f"), F.col("gamma").alias("_gamma"), "rho")
        out = out.join(both, out[fit] == both["_f"]).drop("_f")
    gamma = F.when(F.coalesce(F.col("neutral"), F.lit(neutral_default)), 0.0).otherwise(F.col("_gamma"))

    def s(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0))

    return out.withColumns(
        {
            "lam_home": F.exp(s("_home_a") - s("_away_b") + gamma),
            "lam_away": F.exp(s("_away_a") - s("_home_b")),
        }
    ).drop("_home_a", "_home_b", "_away_a", "_away_b", "_gamma")


def predict_many(matches: DataFrame, teams: DataFrame, shared: DataFrame, top: int = 10, **options) -> DataFrame:
    """Matches with expected goals and outcome probabilities."""
    rated = predict_rates(matches, teams, shared, **options)
    return outcome_probs(rated, F.col("rho"), top=top).drop("rho")


# --- strengths from features ----------------------------------------------------------------------------------


@dataclass
class GoalRegression:
    """Weights of a feature-driven fit: per feature attack and defense, means for centring, gamma and rho."""

    features: list[str]
    means: list[float]
    attack: list[float]
    defense: list[float]
    gamma: float
    rho: float
    steps: list[float] = field(default_factory=list)


def regression_rows(matches: DataFrame, features: list[str], xi: float = 0.0018, ref_date: Column | None = None) -> DataFrame:
    """Complete rows as w, wh, wa, cell and raw features hx0.., ax0..; nothing else is kept for the steps."""
    needed = ["home_score", "away_score", *[f"{s}_{c}" for s in ("home", "away") for c in features]]
    rows = matches.na.drop(subset=needed)
    reference = rows.select(F.max("date")).scalar() if ref_date is None else ref_date
    hg, ag = F.col("home_score"), F.col("away_score")
    return rows.withColumn("w", decay_weight(F.col("date"), reference, xi)).select(
        "w", (F.col("w") * hg).alias("wh"), (F.col("w") * ag).alias("wa"), _cell(hg, ag).alias("cell"),
        *[F.col(f"{s}_{c}").cast("double").alias(f"{s[0]}x{i}") for s in ("home", "away") for i, c in enumerate(features)],
    )


def regression_terms(rows: DataFrame, params: DataFrame, k: int) -> DataFrame:
    """Likelihood terms at the one-row ``params`` (arrays m, wa_, wb_ and gamma, rho), read as a scalar subquery."""
    p = F.col("_p")
    centred = rows.withColumn("_p", params.select(F.struct("*")).scalar()).withColumns(
        {f"{s}c{i}": F.col(f"{s}x{i}") - p["m"][i] for s in "ha" for i in range(k)} | {"rho": p["rho"]}
    )

    def dot(side: str, weights: str) -> Column:
        out = F.lit(0.0)
        for i in range(k):
            out = out + F.col(f"{side}c{i}") * p[weights][i]
        return out

    return _with_terms(
        centred.withColumns(
            {"llh": dot("h", "wa_") - dot("a", "wb_") + p["gamma"], "lla": dot("a", "wa_") - dot("h", "wb_")}
        )
    )


def regression_sums(rows: DataFrame, params: DataFrame, k: int) -> DataFrame:
    """One row: log-likelihood, validity and the gradient by each weight, gamma and rho."""
    terms = regression_terms(rows, params, k)
    ch, ca = F.col("ch"), F.col("ca")
    return terms.agg(
        F.sum("ll").alias("ll"), F.max("bad").alias("bad"), F.sum(ch).alias("dg"), F.sum("cr").alias("dr"),
        *[F.sum(F.col(f"hc{i}") * ch + F.col(f"ac{i}") * ca).alias(f"da{i}") for i in range(k)],
        *[F.sum(-F.col(f"ac{i}") * ch - F.col(f"hc{i}") * ca).alias(f"db{i}") for i in range(k)],
    )


def regression_params(spark: SparkSession, means, attack, defense, gamma: float, rho: float) -> DataFrame:
    row = ([float(x) for x in means], [float(x) for x in attack], [float(x) for x in defense], float(gamma), float(rho))
    return small_table(spark, [row], "m array<double>, wa_ array<double>, wb_ array<double>, gamma double, rho double")


def goal_regression_likelihood(rows: DataFrame, params: DataFrame, k: int) -> DataFrame:
    sums = regression_sums(rows, params, k)
    return sums.select(F.when(F.col("bad") > 0, INVALID).otherwise(-F.col("ll")).alias("nll"))


def goal_regression_fit(matches: DataFrame, features: list[str], xi: float = 0.0018, ref_date: Column | None = None) -> GoalRegression:
    """Weights of the features on attack and defense. Features are centred on their pooled mean; there is no intercept."""
    spark, k = matches.sparkSession, len(features)
    rows = durable(regression_rows(matches, features, xi, ref_date))
    pooled = rows.agg(*[((F.avg(f"hx{i}") + F.avg(f"ax{i}")) / 2).alias(f"m{i}") for i in range(k)]).first()
    means = [pooled[f"m{i}"] for i in range(k)]
    trace: list[float] = []

    def evaluate(points: dict) -> dict:
        ((f, x),) = points.items()
        r = regression_sums(rows, regression_params(spark, means, x[:k], x[k : 2 * k], x[-2], x[-1]), k).first()
        if r["bad"]:
            return {f: (INVALID, np.zeros_like(x))}
        trace.append(-r["ll"])
        grad = [r[f"da{i}"] for i in range(k)] + [r[f"db{i}"] for i in range(k)] + [r["dg"], r["dr"]]
        return {f: (-r["ll"], -np.array(grad))}

    x0 = np.zeros(2 * k + 2)
    x0[-2:] = START_GAMMA, START_RHO
    x = _lockstep({0: x0}, evaluate)[0]
    return GoalRegression(
        features, means, [float(v) for v in x[:k]], [float(v) for v in x[k : 2 * k]], float(x[-2]), float(x[-1]), trace
    )


def coefficients(spark: SparkSession, model: GoalRegression) -> DataFrame:
    rows = list(zip(model.features, model.attack, model.defense))
    return small_table(spark, rows, "feature string, attack_weight double, defense_weight double")


def regression_rates(matches: DataFrame, model: GoalRegression, neutral_default: bool = False) -> DataFrame:
    """lam_home, lam_away of each match from its own features."""

    def dot(side: str, weights: list[float]) -> Column:
        out = F.lit(0.0)
        for c, m, w in zip(model.features, model.means, weights):
            out = out + (F.col(f"{side}_{c}") - m) * w
        return out

    gamma = F.when(F.coalesce(F.col("neutral"), F.lit(neutral_default)), 0.0).otherwise(model.gamma)
    return matches.withColumns(
        {
            "lam_home": F.exp(dot("home", model.attack) - dot("away", model.defense) + gamma),
            "lam_away": F.exp(dot("away", model.attack) - dot("home", model.defense)),
        }
    )


def regression_predict_many(matches: DataFrame, model: GoalRegression, top: int = 10, **options) -> DataFrame:
    return outcome_probs(regression_rates(matches, model, **options), model.rho, top=top)


def implied_strengths(snapshot: DataFrame, model: GoalRegression, entity: str = "team") -> DataFrame:
    """Attack and defense of each entity from its latest features, ranked by their sum."""

    def dot(weights: list[float]) -> Column:
        out = F.lit(0.0)
        for c, m, w in zip(model.features, model.means, weights):
            out = out + (F.col(c) - m) * w
        return out

    rated = snapshot.select(entity, dot(model.attack).alias("attack"), dot(model.defense).alias("defense"))
    return rated.withColumn("skill", F.col("attack") + F.col("defense")).orderBy(F.desc("skill"), entity)
