"""Outcome models over feature columns (logits, and Spark ML's learners), their predictions as columns, and ensembles of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchframe.functions import scores
from matchframe.operators.logits import TRIPLE, Fit, Logit, feature_logit, fit_grid, grid_predict, logit_predict
from matchframe.session import durable, small_table


def _assembled(df: DataFrame, features: list[str], label: str) -> DataFrame:
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("label"))
    return VectorAssembler(inputCols=features, outputCol="features").transform(rows).select("features", "label")


def logit_table(spark: SparkSession, model: Logit) -> DataFrame:
    """Coefficients per class."""
    rows = [
        (i, "intercept" if c is None else c, v)
        for i in range(3)
        for c, v in [(None, model.intercepts[i]), *zip(model.features, model.weights[i])]
    ]
    return small_table(spark, rows, "class int, term string, value double")


def draw_model_rows(rated: DataFrame, home: str = "home_elo_pre", away: str = "away_elo_pre", neutral: str = "neutral", advantage: float = 100.0) -> DataFrame:
    """``rated`` with ``diff``, the effective rating difference over 400; a missing neutral flag counts as not neutral."""
    return rated.withColumn("diff", scores.effective_diff(F.col(home), F.col(away), F.col(neutral), advantage) / 400)


def draw_model_fit(rated: DataFrame, advantage: float = 100.0, **options) -> Logit:
    """Outcome logit on the effective rating difference."""
    truth = scores.outcome(F.col("home_score"), F.col("away_score"))
    return feature_logit(draw_model_rows(rated, advantage=advantage).withColumn("outcome", truth), ["diff"], **options)


def draw_model_predict(df: DataFrame, model: Logit, home: str, away: str, neutral: str = "neutral", advantage: float = 100.0):
    return logit_predict(draw_model_rows(df, home, away, neutral, advantage), model).drop("diff")


@dataclass
class Boosted:
    """One-vs-rest boosted trees."""

    features: list[str]
    models: list[Model]


def boosted_trees(df: DataFrame, features: list[str], label: str = "outcome", rounds: int = 300, depth: int = 4, rate: float = 0.05, seed: int = 0):
    """Three binary boosters, one per class (Spark's booster is binary); predictions are renormalised."""
    rows = durable(_assembled(df, features, label))
    models = []
    for i in range(3):
        one = rows.withColumn("label", (F.col("label") == i).cast("double"))
        booster = GBTClassifier(
            maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, subsamplingRate=0.8, featureSubsetStrategy="0.8"
        )
        models.append(booster.fit(one))
    return Boosted(features, models)


def boosted_predict(df: DataFrame, model: Boosted) -> DataFrame:
    kept = df.columns
    rows = VectorAssembler(inputCols=model.features, outputCol="_x").transform(df)
    for i, m in enumerate(model.models):
        m = m.setFeaturesCol("_x").setProbabilityCol(f"_p{i}").setRawPredictionCol(f"_r{i}").setPredictionCol(f"_c{i}")
        rows = m.transform(rows).withColumn(f"_q{i}", vector_to_array(f"_p{i}")[1])
    total = F.col("_q0") + F.col("_q1") + F.col("_q2")
    return rows.select(*kept, *[(F.col(f"_q{i}") / total).alias(n) for i, n in enumerate(TRIPLE)])


def feature_importance(spark: SparkSession, model: Boosted) -> DataFrame:
    """Mean importance of each feature over the three boosters, largest first."""
    per_model = [m.featureImportances.toArray() for m in model.models]
    rows = [(c, float(sum(v[i] for v in per_model) / len(per_model))) for i, c in enumerate(model.features)]
    return small_table(spark, rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


@dataclass
class Perceptron:
    features: list[str]
    model: Model


def mlp(df: DataFrame, features: list[str], label: str = "outcome", hidden: tuple[int, ...] = (32, 16), max_iter: int = 200, seed: int = 0):
    """Multi-layer perceptron on (standardised) features, three outputs."""
    layers = [len(features), *hidden, 3]
    fitted = MultilayerPerceptronClassifier(layers=layers, maxIter=max_iter, seed=seed).fit(_assembled(df, features, label))
    return Perceptron(features, fitted)


def mlp_predict(df: DataFrame, model: Perceptron) -> DataFrame:
    kept = df.columns
    rows = VectorAssembler(inputCols=model.features, outputCol="_x").transform(df)
    scored = model.model.setFeaturesCol("_x").setProbabilityCol("_p").setRawPredictionCol("_r").setPredictionCol("_c").transform(rows)
    p = vector_to_array("_p")
    return scored.select(*kept, *[p[i].alias(n) for i, n in enumerate(TRIPLE)])


def standardise(train: DataFrame, apply: DataFrame, cols: list[str], prefix: str = "") -> DataFrame:
    """Columns centred and scaled by the training mean and population deviation (a constant column is only centred)."""
    stats = train.select(
        F.struct(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols])
    ).scalar()

    def scaled(c: str) -> Column:
        sd = F.col("_stats")[f"s_{c}"]
        return (F.col(c) - F.col("_stats")[f"m_{c}"]) / F.when(sd == 0, 1.0).otherwise(sd)

    return apply.withColumn("_stats", stats).withColumns({f"{prefix}{c}": scaled(c) for c in cols}).drop("_stats")


def ensemble_average(predictions: DataFrame, keys: list[str], models: list | None = None, model: str = "model") -> DataFrame:
    """Mean of the models' triples per match, renormalised; any subset of models."""
    rows = predictions if models is None else predictions.filter(F.col(model).isin(models))
    mean = rows.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in TRIPLE])
    total = F.col("p_away") + F.col("p_draw") + F.col("p_home")
    return mean.select(*keys, *[(F.col(c) / total).alias(c) for c in TRIPLE])


def side_by_side(predictions: DataFrame, keys: list[str], models: list, model: str = "model") -> DataFrame:
    """One row per match with a column per (model, class): ``p_away_<model>`` and so on."""
    return predictions.groupBy(*keys).agg(
        *[F.max(F.when(F.col(model) == m, F.col(c))).alias(f"{c}_{m}") for m in models for c in TRIPLE]
    ).na.drop(subset=[f"p_home_{m}" for m in models])


def _blend(models: list, weights: list[Column]) -> list[Column]:
    """Weighted triple, renormalised."""
    mixed = [sum((w * F.col(f"{c}_{m}") for m, w in zip(models, weights)), F.lit(0.0)) for c in TRIPLE]
    total = mixed[0] + mixed[1] + mixed[2]
    return [p / total for p in mixed]


def simplex(n: int, steps: int) -> list[tuple[float, ...]]:
    """All weights of ``n`` models that are multiples of 1/steps and add up to 1."""
    if n == 1:
        return [(1.0,)]

    def parts(left: int, slots: int):
        if slots == 1:
            yield (left,)
            return
        for i in range(left + 1):
            for rest in parts(left - i, slots - 1):
                yield (i, *rest)

    return [tuple(p / steps for p in w) for w in parts(steps, n)]


def weight_scores(wide: DataFrame, models: list, steps: int = 10, truth: str = "outcome") -> DataFrame:
    """Log-loss of every simplex weight over side-by-side predictions (66 weights for 3 models and tenths).

    A row adds its loss under each weight to that weight's sum; no row is copied, and a task sends one row of sums.
    """
    grid = simplex(len(models), steps)
    names = [f"w{i}" for i in range(len(models))]

    def loss(weights: tuple[float, ...]) -> Column:
        return F.avg(scores.log_loss_term(F.col(truth), *_blend(models, [F.lit(w) for w in weights])))

    sums = wide.agg(*[loss(w).alias(f"{k}") for k, w in enumerate(grid)])
    rows = sums.unpivot([], [f"{k}" for k in range(len(grid))], "_k", "log_loss")
    weights = small_table(wide.sparkSession, [(f"{k}", *w) for k, w in enumerate(grid)], "_k string, " + ", ".join(f"{n} double" for n in names))
    return rows.join(weights, "_k").where(F.col("log_loss").isNotNull()).select(*names, "log_loss")


def weight_grid_search(tune: DataFrame, test: DataFrame, models: list, steps: int = 10, truth: str = "outcome") -> DataFrame:
    """Best weights on the tuning fold (the first of the grid on a tie), and their scores on the test fold."""
    names = [f"w{i}" for i in range(len(models))]
    tuned = weight_scores(tune, models, steps, truth)
    best = tuned.agg(F.min(F.struct(F.round("log_loss", 12).alias("log_loss"), *names)).alias("b")).select("b.*")
    weighted = test.withColumn("_w", best.select(F.struct(*names)).scalar())
    blended = weighted.select(
        F.col(truth), "_w", *[p.alias(c) for c, p in zip(TRIPLE, _blend(models, [F.col("_w")[n] for n in names]))]
    )
    triple = [F.col(c) for c in TRIPLE]
    return blended.groupBy("_w").agg(
        F.avg(scores.log_loss_term(F.col(truth), *triple)).alias("test_log_loss"),
        F.avg((scores.pick(*triple) == F.col(truth)).cast("double")).alias("test_accuracy"),
    ).select("_w.*", "test_log_loss", "test_accuracy")


def stack(wide: DataFrame, models: list, folds: list, fold: str = "fold", truth: str = "outcome", **options) -> DataFrame:
    """Meta logit on the base triples: each fold's meta model sees earlier folds only. ``folds`` excludes the first.

    The meta models of all folds are fitted together.
    """
    features = tuple(f"{c}_{m}" for m in models for c in TRIPLE)
    grid = fit_grid(wide, [Fit("stack", features, f) for f in folds], truth, at=fold, **options)
    return grid_predict(wide, grid, fold=fold).drop("config")


def probability_curve(spark: SparkSession, model: Logit, low: float = -400.0, high: float = 400.0, points: int = 200) -> DataFrame:
    """Model probabilities and the plain expected score over evenly spaced rating differences."""
    i = F.col("id")
    diff = F.lit(low) + i * ((high - low) / (points - 1))
    rows = spark.range(points).select(diff.alias("rating_diff"), (diff / 400).alias(model.features[0]))
    expected = scores.expected_score(F.col("rating_diff"), F.lit(0.0))
    return logit_predict(rows, model).select("rating_diff", *TRIPLE, expected.alias("expected_score"))
