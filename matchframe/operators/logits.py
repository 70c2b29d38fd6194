"""Multinomial logits of a whole grid of configurations and folds, fitted together.

All fits take Newton steps in lockstep. A step is one pass over the rows, in which every row is looked at once: a task
adds up, for each fit that is still open, the loss, its gradient and its Hessian over the rows that the fit trains on, and
Spark adds these sums over the tasks. Rows are not copied to folds or configurations. The driver holds a few numbers per
fit (for f features, 3 (f + 1) coefficients and the square of that). A step that does not lower the penalised loss is
halved; a fit is done when its gradient vanishes.

The loss is the summed log-loss with an L2 penalty of 1 / (2 C) on the weights, not on the intercepts. Intercepts are
centred, as only their differences count. A class that does not occur in training gets probability 0.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchframe.session import small_table, written

# Tasks get the sums' code itself, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TRIPLE = ("p_away", "p_draw", "p_home")
CLASSES = 3
#: Exponent of a class that never occurs.
_NEVER = -700.0


@dataclass
class Logit:
    """Multinomial logit: one intercept and one weight per feature for classes 0, 1, 2."""

    features: list[str]
    intercepts: list[float]
    weights: list[list[float]]


@dataclass(frozen=True)
class Fit:
    """Rows whose ``at`` is before ``fold`` (all rows if it is None) train the features of a configuration.

    ``only`` is a condition on training rows; ``fill`` ("zero" or "mean", of the training rows) is for the missing values
    of ``fill_cols``. Rows with a feature still missing are left out.
    """

    config: str
    features: tuple[str, ...]
    fold: int | None = None
    only: str | None = None
    fill: str | None = None
    fill_cols: tuple[str, ...] = ()


@dataclass
class Grid:
    """Fits with their models (None where there were too few rows), training rows, and values for missing features."""

    fits: list[Fit]
    models: list[Logit | None] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    fills: list[dict[str, float]] = field(default_factory=list)
    steps: int = 0

    @property
    def features(self) -> list[str]:
        return list(dict.fromkeys(c for f in self.fits for c in f.features))


def linear(model: Logit, i: int) -> Column:
    out = F.lit(model.intercepts[i])
    for c, w in zip(model.features, model.weights[i]):
        out = out + F.col(c) * w
    return out


def logit_predict(df: DataFrame, model: Logit, names: tuple[str, str, str] = TRIPLE) -> DataFrame:
    """Probabilities of the three classes as plain column arithmetic."""
    scored = df.withColumns({f"_z{i}": linear(model, i) for i in range(CLASSES)})
    return _softmax(scored, names)


def _softmax(scored: DataFrame, names: tuple[str, str, str]) -> DataFrame:
    """Probabilities from the exponents _z0, _z1, _z2."""
    top = F.greatest("_z0", "_z1", "_z2")
    raised = scored.withColumns({f"_e{i}": F.exp(F.col(f"_z{i}") - top) for i in range(CLASSES)})
    total = F.col("_e0") + F.col("_e1") + F.col("_e2")
    return raised.withColumns({n: F.col(f"_e{i}") / total for i, n in enumerate(names)}).drop(*[f"_{s}{i}" for s in "ze" for i in range(CLASSES)])


# --- sums over the rows -----------------------------------------------------------------------------------------


def _means(rows: DataFrame, fits: list[Fit], flags: list[str | None]) -> list[dict[str, float]]:
    """Values for missing features of each fit: 0, or the training mean (0 where all are missing); one aggregate for all.

    ``rows`` are those ``Training`` has written, whose columns f0, f1, ... tell of each of the ``flags`` where it holds.
    """
    wanted = {(f.only, f.fold, c) for f in fits if f.fill == "mean" for c in f.fill_cols}
    sums = {}
    for k, (only, fold, c) in enumerate(sorted(wanted, key=str)):
        trains = F.col(f"f{flags.index(only)}") if fold is None else F.col(f"f{flags.index(only)}") & (F.col("at") < fold)
        sums[only, fold, c] = (f"m{k}", F.avg(F.when(trains, F.col(c))).alias(f"m{k}"))
    found = rows.agg(*[s for _, s in sums.values()]).first() if sums else None
    return [
        {} if f.fill is None else {c: 0.0 if f.fill == "zero" else (found[sums[f.only, f.fold, c][0]] or 0.0) for c in f.fill_cols} for f in fits
    ]


#: Rows that are looked at together: their products stay in a core's cache.
BLOCK = 2048


def _summer(names: list[str], flags: list[str | None], plans: list[tuple]):
    """Loss, class counts, gradient and Hessian of every plan (number, feature places, fills, fold, flag, coefficients).

    Plans with the same features and fills see the same rows, so they share the products of the features; their weights
    are the columns of one matrix. As a row's probabilities add up to 1, three blocks of the Hessian give all nine.
    """
    shared: dict[tuple, list[tuple]] = {}
    for number, places, fills, fold, flag, w in plans:
        shared.setdefault((tuple(places), tuple(fills)), []).append((number, fold, flag, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for whole in batches:
            for begin in range(0, whole.num_rows, BLOCK):
                b = whole.slice(begin, BLOCK)
                values = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names]) if names else np.zeros((0, b.num_rows))
                y = b.column("y").to_numpy(zero_copy_only=False)
                at = b.column("at").to_numpy(zero_copy_only=False)
                held = {f: b.column(f"f{k}").to_numpy(zero_copy_only=False) for k, f in enumerate(flags)}
                for (places, fills), same in shared.items():
                    x = np.concatenate([np.ones((1, b.num_rows)), values[list(places)]])
                    for place, v in fills:
                        x[1 + place, np.isnan(x[1 + place])] = v
                    own = np.stack([held[flag] if fold is None else held[flag] & (at < fold) for _, fold, flag, _ in same])
                    own &= ~np.isnan(x).any(axis=0)
                    used = own.any(axis=0)
                    if used.all():
                        sums = _sums_of(x, y, own, np.stack([w for *_, w in same]))
                    else:
                        sums = _sums_of(x[:, used], y[used], own[:, used], np.stack([w for *_, w in same]))
                    for (number, *_), found in zip(same, sums, strict=True):
                        total[number] = total.get(number, 0) + found
        flat = [pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(flat, names=["fit", "sums"])

    return run


def _sums_of(x: np.ndarray, y: np.ndarray, own: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A row of sums per plan: loss, class counts, gradient, Hessian. ``own``: (plans, rows), whether a plan trains on a row."""
    d, plans = len(x), len(w)
    own = own.astype(float)
    z = [w[:, c] @ x for c in range(CLASSES)]
    top = np.maximum(np.maximum(z[0], z[1]), z[2])
    p = [np.exp(v - top) for v in z]
    total = p[0] + p[1] + p[2]
    truth = [(y == c).astype(float) for c in range(CLASSES)]
    loss = ((np.log(total) + top - sum(v * t for v, t in zip(z, truth, strict=True))) * own).sum(axis=1)
    p = [v / total * own for v in p]
    gradient = np.stack([(p[c] - truth[c] * own) @ x.T for c in range(CLASSES)], axis=1)
    i, j = np.triu_indices(d)
    products = (x[i] * x[j]).T
    block = np.empty((CLASSES, plans, d, d))
    for k, weight in enumerate((p[0] - p[0] * p[0], -p[0] * p[1], p[1] - p[1] * p[1])):
        block[k][:, i, j] = block[k][:, j, i] = weight @ products
    h00, h01, h11 = block
    h02, h12 = -(h00 + h01), -(h01 + h11)
    hessian = np.stack([h00, h01, h02, h01, h11, h12, h02, h12, -(h02 + h12)]).reshape(CLASSES, CLASSES, plans, d, d).transpose(2, 0, 3, 1, 4)
    counts = own @ np.stack(truth, axis=1)
    return np.concatenate([loss[:, None], counts, gradient.reshape(plans, CLASSES * d), hessian.reshape(plans, (CLASSES * d) ** 2)], axis=1)


class Training:
    """Rows reduced to what the fits look at, stored once."""

    def __init__(self, rows: DataFrame, fits: list[Fit], label: str, at: str | None):
        self.fits = fits
        self.names = list(dict.fromkeys(c for f in fits for c in f.features))
        self.flags = list(dict.fromkeys(f.only for f in fits))
        filled = [c for f in fits if f.fill == "mean" for c in f.fill_cols]
        flag = [F.coalesce(F.expr(o), F.lit(False)) if o is not None else F.lit(True) for o in self.flags]
        used = [*[f"f{k}" for k in range(len(flag))], "y", "at"]
        kept = rows.select(
            *[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*self.names, *filled])], F.when(F.col(label).isin(0, 1, 2), F.col(label)).cast("int").alias("y"),
            (F.lit(0) if at is None else F.coalesce(F.col(at).cast("int"), F.lit(2**31 - 1))).alias("at"), *[f.alias(f"f{k}") for k, f in enumerate(flag)],
        )
        table = written(kept)
        self.fills = _means(table, fits, self.flags)
        self.rows = table.where("y is not null").select(*self.names, *used)

    def sums(self, coefficients: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
        """(loss, class counts, gradient, Hessian) of the numbered fits at the given coefficients; one job."""
        plans = []
        for k, w in coefficients.items():
            f = self.fits[k]
            fills = [(f.features.index(c), v) for c, v in self.fills[k].items() if c in f.features]
            plans.append((k, [self.names.index(c) for c in f.features], fills, f.fold, f.only, w))
        partial = self.rows.mapInArrow(_summer(self.names, self.flags, plans), "fit int, sums array<double>")
        added = partial.select("fit", F.posexplode("sums").alias("i", "v")).groupBy("fit", "i").agg(F.sum("v").alias("v")).collect()
        size = {k: 1 + CLASSES + w.size + w.size**2 for k, w in coefficients.items()}
        flat = {k: np.zeros(n) for k, n in size.items()}
        for r in added:
            flat[r["fit"]][r["i"]] = r["v"]
        out = {}
        for k, v in flat.items():
            n = coefficients[k].size
            out[k] = float(v[0]), v[1 : 1 + CLASSES], v[1 + CLASSES : 1 + CLASSES + n].reshape(coefficients[k].shape), v[1 + CLASSES + n :].reshape(n, n)
        return out


# --- the fits ---------------------------------------------------------------------------------------------------


def fit_grid(rows: DataFrame, fits: list[Fit], label: str = "outcome", at: str | None = None, c: float = 1.0, least: int = 1, tolerance: float = 1e-9, steps: int = 60) -> Grid:
    """Models of all fits. Fits with fewer than ``least`` training rows have none.

    ``tolerance`` is on the largest component of the gradient, over the number of training rows.
    """
    training = Training(rows, fits, label, at)
    grid = Grid(fits, [None] * len(fits), [0] * len(fits), training.fills)
    trial = {k: np.zeros((CLASSES, 1 + len(f.features))) for k, f in enumerate(fits)}
    held: dict[int, tuple[np.ndarray, float, np.ndarray]] = {}  # accepted coefficients, their loss and the step from there
    open_ = set(trial)
    while open_ and grid.steps < steps:
        grid.steps += 1
        found = training.sums({k: trial[k] for k in sorted(open_)})
        for k, (loss, counts, gradient, hessian) in found.items():
            w, n = trial[k], int(counts.sum())
            grid.sizes[k] = n
            if n < max(1, least):
                open_.discard(k)
                continue
            never = counts == 0
            if never.any() and not (w[never, 0] == _NEVER).all():
                trial[k] = w.copy()
                trial[k][never, 0] = _NEVER
                continue
            loss += (w[:, 1:] ** 2).sum() / (2 * c)
            if k in held and loss > held[k][1] + 1e-12 * abs(held[k][1]):
                step = held[k][2] / 2
                held[k] = (held[k][0], held[k][1], step)
                trial[k] = held[k][0] - step
                if np.abs(step).max() < 1e-14:
                    trial[k] = held[k][0]
                    open_.discard(k)
                continue
            gradient, hessian = _penalised(w, gradient, hessian, n, c, never)
            if np.abs(gradient).max() <= tolerance * n:
                open_.discard(k)
                continue
            step = np.linalg.solve(hessian, gradient.ravel()).reshape(w.shape)
            held[k] = (w, loss, step)
            trial[k] = w - step
    for k, f in enumerate(fits):
        if grid.sizes[k] >= max(1, least):
            w = trial[k]
            centre = w[:, 0].mean() if (w[:, 0] > _NEVER / 2).all() else 0.0
            grid.models[k] = Logit(list(f.features), (w[:, 0] - centre).tolist(), w[:, 1:].tolist())
    return grid


def _penalised(w: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, n: int, c: float, never: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """With the penalty's part; intercepts are held to one sum, and classes that never occur to their coefficients."""
    gradient = gradient.copy()
    gradient[:, 1:] += w[:, 1:] / c
    gradient[never] = 0
    d = w.shape[1]
    ridge = np.full(w.shape, 1 / c)
    ridge[:, 0] = 0
    out = hessian + np.diag(ridge.ravel())
    first = np.arange(CLASSES) * d
    out[np.ix_(first, first)] += n / CLASSES**2
    fixed = np.repeat(never, d)
    out[fixed], out[:, fixed] = 0, 0
    out[fixed, fixed] = 1
    return gradient, out


def feature_logit(df: DataFrame, features: list[str], label: str = "outcome", c: float = 1.0, **options) -> Logit:
    """Multinomial logit with an L2 penalty of 1/C on the summed loss, i.e. 1/(C n) on the mean; no scaling."""
    model = fit_grid(df, [Fit("one", tuple(features))], label, c=c, **options).models[0]
    if model is None:
        raise ValueError("no row has an outcome and all features")
    return model


def models_table(df: DataFrame, grid: Grid) -> DataFrame:
    """(config, fold, uses, fills, w): a row per model, over the grid's features in their order."""
    rows = []
    for f, m, fills in zip(grid.fits, grid.models, grid.fills, strict=True):
        if m is None:
            continue
        place = {c: j for j, c in enumerate(m.features)}
        weights = [[m.intercepts[i], *[m.weights[i][place[c]] if c in place else 0.0 for c in grid.features]] for i in range(CLASSES)]
        rows.append((f.config, f.fold, [c in place for c in grid.features], [fills.get(c) for c in grid.features], [v for w in weights for v in w]))
    return small_table(df.sparkSession, rows, "config string, fold int, uses array<boolean>, fills array<double>, w array<double>")


def grid_predict(tests: DataFrame, grid: Grid, names: tuple[str, str, str] = TRIPLE, fold: str = "fold") -> DataFrame:
    """``tests`` with config and probabilities, a row for each configuration that has a model of the row's fold.

    Rows that miss a feature of a configuration, which it does not fill, have no row there.
    """
    models = models_table(tests, grid).withColumnsRenamed({"fold": "_fold", "uses": "_uses", "fills": "_fills", "w": "_w"})
    joined = tests.join(models, tests[fold] == models["_fold"])
    x = F.zip_with(F.array(*[F.col(c).cast("double") for c in grid.features]), "_fills", lambda v, f: F.coalesce(v, f))
    joined = joined.withColumn("_x", x)
    whole = F.forall(F.zip_with("_x", "_uses", lambda v, u: ~u | v.isNotNull()), lambda ok: ok)
    d = 1 + len(grid.features)

    def exponent(i: int) -> Column:
        weights = F.slice("_w", i * d + 2, d - 1)
        return F.aggregate(F.zip_with("_x", weights, lambda v, c: F.coalesce(v, F.lit(0.0)) * c), F.get("_w", F.lit(i * d)), lambda a, v: a + v)

    scored = joined.where(whole).withColumns({f"_z{i}": exponent(i) for i in range(CLASSES)})
    return _softmax(scored, names).drop("_fold", "_uses", "_fills", "_w", "_x")


def likelihood(rows: DataFrame, grid: Grid, label: str = "outcome", at: str | None = None, c: float = 1.0) -> DataFrame:
    """(config, fold, n, log_likelihood, class, term, gradient) of the grid's models on their training rows.

    The likelihood has the penalty of 1 / (2 C) taken off; gradients are its derivatives.
    """
    training = Training(rows, grid.fits, label, at)
    at_ = {k: np.array([[m.intercepts[i], *m.weights[i]] for i in range(CLASSES)]) for k, m in enumerate(grid.models) if m is not None}
    out = []
    for k, (loss, counts, gradient, _) in training.sums(at_).items():
        f, w = grid.fits[k], at_[k]
        total = -loss - float((w[:, 1:] ** 2).sum()) / (2 * c)
        slope = -gradient
        slope[:, 1:] -= w[:, 1:] / c
        for i in range(CLASSES):
            out += [(f.config, f.fold, int(counts.sum()), total, i, t, float(v)) for t, v in zip(["intercept", *f.features], slope[i], strict=True)]
    return small_table(rows.sparkSession, out, "config string, fold int, n long, log_likelihood double, class int, term string, gradient double")
