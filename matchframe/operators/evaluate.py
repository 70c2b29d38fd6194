"""Walk-forward folds and the metrics on their predictions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchframe.functions import scores
from matchframe.functions.constants import TOP_EVENT
from matchframe.functions.dates import floor_days
from matchframe.operators import goals, outcome, ratings
from matchframe.operators.clean import fill, require
from matchframe.operators.logits import Fit, fit_grid, grid_predict
from matchframe.session import durable, small_table

TRIPLE = outcome.TRIPLE


# --- metrics --------------------------------------------------------------------------------------------------


def _triple() -> list[Column]:
    return [F.col(c) for c in TRIPLE]


def metrics3(truth: str = "outcome") -> list[Column]:
    """n, log-loss, accuracy and Brier score of three-class predictions, as aggregates."""
    y, p = F.col(truth), _triple()
    clipped = [scores.clipped(c) for c in p]
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg(scores.log_loss_term(y, *p)).alias("log_loss"),
        F.avg((scores.pick(*clipped) == y).cast("double")).alias("accuracy"),
        F.avg(scores.brier_term(y, *clipped)).alias("brier"),
    ]


def score3(predictions: DataFrame, by: list[str], truth: str = "outcome") -> DataFrame:
    return predictions.groupBy(*by).agg(*metrics3(truth))


def score_pooled(predictions: DataFrame, config: str, fold: str, truth: str = "outcome") -> DataFrame:
    """Scores per (configuration, fold) and, with a null fold, over all folds of a configuration."""
    rolled = predictions.rollup(config, fold).agg(*metrics3(truth), F.grouping(config).alias("_all"))
    return rolled.filter(F.col("_all") == 0).drop("_all")


def score_binary(predictions: DataFrame, by: list[str], p: str = "home_win_prob", truth: str = "home_win") -> DataFrame:
    """n, log-loss and accuracy of P(home win); an even probability rounds to 0 (half to even)."""
    hit = (F.rint(p) == F.col(truth)).cast("double")
    return predictions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(scores.binary_log_loss_term(F.col(truth), F.col(p))).alias("log_loss"), F.avg(hit).alias("accuracy")
    )


def calibration(df: DataFrame, p: str, y: Column, edges: list[float], include_lowest: bool = False) -> DataFrame:
    """Per right-closed bin: n, mean prediction, mean outcome. Empty bins are absent."""
    x, index = F.col(p), None
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        inside = ((x >= low) if include_lowest and i == 0 else (x > low)) & (x <= high)
        index = F.when(inside, i) if index is None else index.when(inside, i)
    binned = df.select(x.alias("p"), y.cast("double").alias("y"), index.alias("bin")).filter(F.col("bin").isNotNull())
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("pred"), F.avg("y").alias("actual"))


def rescore_binary(binary: DataFrame, three: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Both models on P(home win), side by side per fold; here a pick needs more than one half."""
    joined = binary.select(*keys, F.col("home_win_prob").alias("_b")).join(three, keys)
    y = (F.col("outcome") == scores.HOME).cast("int")
    b, t = scores.clipped(F.col("_b")), scores.clipped(F.col("p_home"))

    def hit(p: Column) -> Column:
        return F.avg(((p > 0.5).cast("int") == y).cast("double"))

    return joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(scores.binary_log_loss_term(y, b)).alias("binary_ll_home"),
        F.avg(scores.binary_log_loss_term(y, t)).alias("three_ll_home"), hit(b).alias("binary_acc_home"), hit(t).alias("three_acc_home"),
    )


def compare(a: DataFrame, b: DataFrame, fold: str, cols: list[str], names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Two score tables side by side per fold, and their means in a row with a null fold."""
    left, right = (
        t.select(fold, *[F.col(c).alias(f"{name}_{c}") for c in cols]) for t, name in ((a, names[0]), (b, names[1]))
    )
    joined = left.join(right, fold)
    return joined.rollup(fold).agg(*[F.avg(f"{name}_{c}").alias(f"{name}_{c}") for name in names for c in cols])


def argmax_flips(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose pick differs between two models, with both picks and the truth by name."""
    second = b.select(*keys, *[F.col(c).alias(f"{c}_2") for c in TRIPLE])
    joined = a.join(second, keys).withColumns(
        {"_1": scores.pick(*_triple()), "_2": scores.pick(*[F.col(f"{c}_2") for c in TRIPLE])}
    )
    return joined.filter(F.col("_1") != F.col("_2")).select(
        *keys, scores.pick_name(F.col("_1")).alias("pick_1"), scores.pick_name(F.col("_2")).alias("pick_2"),
        scores.pick_name(F.col("outcome")).alias("actual"), F.col("p_home").alias("p_home_1"), "p_home_2",
    )


# --- walk-forward ---------------------------------------------------------------------------------------------


def test_rows(matches: DataFrame, years: list[int], label: str | None = TOP_EVENT) -> DataFrame:
    """Rows to predict: the fold year's matches of the target label. ``fold`` is the year."""
    rows = matches.withColumn("fold", F.year("date")).filter(F.col("fold").isin(years))
    return rows if label is None else rows.filter(F.col("tournament") == label)


def frozen_ratings(states: DataFrame, years: list[int]) -> DataFrame:
    """(key, fold, team, ratings) as they stood before the fold year: last played year before it, not yet regressed."""
    stands = F.filter(
        F.array(*[F.lit(y) for y in years]),
        lambda y: (y > F.col("year")) & (F.col("next_year").isNull() | (y <= F.col("next_year"))),
    )
    return states.withColumn("fold", F.explode(stands)).drop("year", "next_year")


def walk_forward_ratings(
    matches: DataFrame, years: list[int], key: str = "league", params: ratings.RatingParams = ratings.RatingParams(),
    label: str | None = TOP_EVENT, members: DataFrame | None = None, neutral_default: bool = True,
) -> DataFrame:
    """Predictions of each fold from ratings frozen at the end of the year before. One rating pass serves all folds."""
    # Stored: a lost executor must not cost the chain, and both sides read it.
    frozen = durable(frozen_ratings(ratings.elo_states(matches, key, params, members), years))
    rows = test_rows(matches, years, label)
    for side in ("home", "away"):
        part = frozen.select(
            F.col("key").alias("_k"), F.col("fold").alias("_f"), F.col("team").alias("_t"), F.col("r0").alias("_r")
        )
        cond = (rows[key] == part["_k"]) & (rows["fold"] == part["_f"]) & (rows[f"{side}_team"] == part["_t"])
        rows = rows.join(part, cond, "left").drop("_k", "_f", "_t").withColumnRenamed("_r", f"{side}_elo")
    start = F.lit(params.initial)
    neutral = F.coalesce(F.col("neutral"), F.lit(neutral_default))
    rated = rows.withColumns({f"{s}_elo": F.coalesce(f"{s}_elo", start) for s in ("home", "away")} | {"neutral": neutral})
    home = F.col("home_elo") + F.when(F.col("neutral"), 0.0).otherwise(params.home_advantage)
    return rated.withColumns(
        {
            "home_win_prob": scores.expected_score(home, F.col("away_elo")),
            "home_win": scores.home_win(F.col("home_score"), F.col("away_score")),
            "outcome": scores.outcome(F.col("home_score"), F.col("away_score")),
        }
    )


def walk_forward_draw(
    matches: DataFrame, rated: DataFrame, years: list[int], min_year: int = 1990, advantage: float = 100.0, **options
) -> DataFrame:
    """Three-outcome predictions: per fold a logit on the pre-match ratings of earlier years (not before ``min_year``).

    The logits of all folds are fitted together. ``rated`` has the columns of ``elo_fold``. ``options`` as for ``walk_forward_ratings``.
    """
    frozen = walk_forward_ratings(matches, years, **options)
    train = rated.select("match_id", "home_elo_pre", "away_elo_pre").join(matches, "match_id").filter(F.year("date") >= min_year)
    train = outcome.draw_model_rows(train, advantage=advantage).select(
        "diff", F.year("date").alias("year"), scores.outcome(F.col("home_score"), F.col("away_score")).alias("outcome")
    )
    grid = fit_grid(train, [Fit("draw", ("diff",), y) for y in years], at="year")
    return grid_predict(outcome.draw_model_rows(frozen, "home_elo", "away_elo", advantage=advantage), grid).drop("config", "diff")


def fold_sums(matches: DataFrame, years: list[int], rates: list[float], min_year: int = 1990) -> DataFrame:
    """``pair_sums`` of every (fold year, decay rate), fit key "year|rate", from one pass over the matches.

    Matches are summed per year with weights as of the next 1 January, one set of sums per rate; a fold adds up the
    earlier years, each scaled by its whole days to the fold's own 1 January. No match is copied to folds.
    """
    played = matches.filter(
        (F.year("date") >= min_year) & F.col("home_score").isNotNull() & F.col("away_score").isNotNull()
    ).withColumn("_year", F.year("date"))
    next_year = F.make_date(F.col("_year") + 1, F.lit(1), F.lit(1)).cast("timestamp_ntz")
    days = floor_days(F.col("date"), next_year)
    hg, ag = F.col("home_score"), F.col("away_score")
    sums = []
    for i, xi in enumerate(rates):
        w = F.exp(-xi * days)
        sums += [F.sum(w).alias(f"w{i}"), F.sum(w * hg).alias(f"h{i}"), F.sum(w * ag).alias(f"a{i}")]
    per_year = played.groupBy(
        "_year", F.col("home_team").alias("home"), F.col("away_team").alias("away"), goals._cell(hg, ag).alias("cell")
    ).agg(*sums)
    cases = []
    for y in years:
        start = F.lit(f"{y}-01-01").cast("timestamp_ntz")
        for i, xi in enumerate(rates):
            s = F.exp(-xi * floor_days(next_year, start))
            cases.append(
                F.when(
                    F.col("_year") < y,
                    F.struct(
                        F.lit(f"{y}|{xi}").alias("fit"), (F.col(f"w{i}") * s).alias("w"), (F.col(f"h{i}") * s).alias("wh"),
                        (F.col(f"a{i}") * s).alias("wa"),
                    ),
                )
            )
    fits = per_year.select("home", "away", "cell", F.explode(F.array_compact(F.array(*cases))).alias("_f"))
    return fits.select("_f.fit", "home", "away", "cell", "_f.w", "_f.wh", "_f.wa").groupBy("fit", "home", "away", "cell").agg(
        F.sum("w").alias("w"), F.sum("wh").alias("wh"), F.sum("wa").alias("wa")
    )


def walk_forward_goals(
    matches: DataFrame, years: list[int], rates: list[float] = (0.0018,), min_year: int = 1990,
    label: str | None = TOP_EVENT, neutral_default: bool = True, top: int = 10,
) -> DataFrame:
    """Predictions of the goal model per (fold, decay rate): all fits are optimised together."""
    model = goals.goal_model_fit(fold_sums(matches, years, list(rates), min_year))
    tests = test_rows(matches, years, label).withColumn("rate", F.explode(F.array(*[F.lit(x) for x in rates])))
    keyed = tests.withColumn("_fitkey", F.concat_ws("|", "fold", F.col("rate").cast("string")))
    fits = model.teams.withColumn("fit", _fit_key(F.col("fit"))), model.shared.withColumn("fit", _fit_key(F.col("fit")))
    predicted = goals.predict_many(keyed, *fits, top=top, fit="_fitkey", neutral_default=neutral_default)
    return predicted.withColumn("outcome", scores.outcome(F.col("home_score"), F.col("away_score"))).drop("_fitkey")


def _fit_key(fit: Column) -> Column:
    """"year|rate" with the rate as Spark prints a double."""
    parts = F.split(fit, r"\|")
    return F.concat_ws("|", parts[0], parts[1].cast("double").cast("string"))


def sweep(scored: DataFrame, label: str, labels: list, fold: str = "fold", value: str = "log_loss") -> tuple[DataFrame, DataFrame]:
    """(fold x label table of a metric, mean per label with the best one flagged) of a parameter grid's scores."""
    table = scored.groupBy(fold).pivot(label, labels).agg(F.avg(value))
    means = scored.groupBy(label).agg(F.avg(value).alias(value))
    best = means.select(F.min_by(label, value)).scalar()
    return table, means.withColumn("best", F.col(label) == best)


def grid_of(configs: dict[str, dict], years: list[int]) -> list[Fit]:
    """A fit for each configuration and fold; see ``ablation``."""
    return [
        Fit(name, tuple(c["features"]), y, c.get("train_filter"), c.get("fill"), tuple(c.get("fill_cols", c["features"])) if c.get("fill") else ())
        for name, c in configs.items() for y in years
    ]


def ablation(
    rows: DataFrame, configs: dict[str, dict], years: list[int], label: str | None = TOP_EVENT, min_train: int = 200, **options,
) -> tuple[DataFrame, DataFrame]:
    """(predictions of every configuration and fold, (config, fold, n_train, reason) of every fold).

    A configuration names its ``features`` and optionally ``fill`` ("zero" or "mean", over ``fill_cols``) and
    ``train_filter`` (a condition on training rows, as SQL). The logits of all configurations and folds are fitted
    together. Folds with fewer than ``min_train`` training rows have no predictions; ``reason`` says so, else it is null.
    """
    held = rows.withColumn("_year", F.year("date"))
    grid = fit_grid(held, grid_of(configs, years), at="_year", least=min_train, **options)
    predicted = grid_predict(test_rows(rows, years, label), grid).select("config", "fold", "match_id", "outcome", *TRIPLE)
    sizes = [(f.config, f.fold, n, f"fewer than {min_train} training rows" if m is None else None) for f, m, n in zip(grid.fits, grid.models, grid.sizes)]
    return predicted, small_table(rows.sparkSession, sizes, "config string, fold int, n_train long, reason string")


def ablation_of(
    rows: DataFrame, configs: dict[str, dict], years: list[int], fit: Callable, predict: Callable, label: str | None = TOP_EVENT, min_train: int = 200,
) -> DataFrame:
    """Predictions as ``ablation`` gives them, of any model: ``fit(train, features)`` and ``predict(rows, model)``, fold by fold."""
    tests, held, parts = test_rows(rows, years, label), durable(rows), []
    for f in grid_of(configs, years):
        features, cols = list(f.features), list(f.fill_cols)
        train = held.filter(F.year("date") < f.fold)
        train = train if f.only is None else train.filter(f.only)
        test = tests.filter(F.col("fold") == f.fold)
        if f.fill:
            train, test = fill(train, cols, f.fill), fill(test, cols, f.fill, train)
        train = require(train, features)
        if train.limit(min_train).count() >= min_train:
            scored = predict(require(test, features), fit(train, features))
            parts.append(scored.select(F.lit(f.config).alias("config"), "fold", "match_id", "outcome", *TRIPLE))
    return reduce(DataFrame.unionByName, parts)
