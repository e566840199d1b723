"""The learner catalogue: each fits on a DataFrame and predicts as a DataFrame."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (
    DecisionTreeRegressor, RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurelab.functions.draws import SEED
from featurelab.models import gram
from featurelab.models.bayes import class_table, predict_class
from featurelab.models.forests import Forest, grow_forests
from featurelab.models.gram import (
    Moments, bayesian_ridge, fold_moments, least_squares, linear_prediction, relevance_regression,
)
from featurelab.models.jobs import JOBS, side_by_side
from featurelab.models.trees import Boosting, Fit, binned, grow
from featurelab.operators.metrics import regression_report
from featurelab.sources.work import materialize

_VECTOR = "_features"


@dataclass
class Fitted:
    """``predict`` adds a ``prediction`` column."""

    predict: Callable[[DataFrame], DataFrame]
    model: object = None


@dataclass
class Learner:
    name: str
    fit: Callable[[DataFrame, list[str], str], Fitted]


def _assembled(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol=_VECTOR)


def _fit_trees(estimator) -> Callable[[DataFrame, list[str], str], Fitted]:
    def fit(train: DataFrame, features: list[str], target: str) -> Fitted:
        vectors = _assembled(features)
        set_up = estimator.copy({estimator.featuresCol: _VECTOR, estimator.labelCol: target})
        model = set_up.fit(vectors.transform(train))
        return Fitted(lambda df: model.transform(vectors.transform(df)).drop(_VECTOR), model)

    return fit


@dataclass
class BoostedFit:
    """Boosting by ``models.trees``. With patience a hashed share of the training rows is watched, or the
    given rows ``leaky`` (those scored later) instead, which flatters the score.

    Scorers and bake-offs grow many such learners side by side.
    """

    settings: Boosting
    leaky: DataFrame | None = None

    @property
    def watch(self) -> str | None:
        return None if self.settings.patience is None else "share" if self.leaky is None else "test"

    def __call__(self, train: DataFrame, features: list[str], target: str) -> Fitted:
        if self.watch == "test":
            # The watched rows are the fold left out.
            columns = [F.col(f"`{c}`") for c in [*features, target]]
            train = train.select(*columns, F.lit(0).alias("_fold")).unionByName(self.leaky.select(*columns, F.lit(1).alias("_fold")))
            table, test = binned(train, features, target, "_fold"), 1
        else:
            table, test = binned(train, features, target), None
        model = grow(table, [Fit(tuple(range(len(features))), self.settings, test, self.watch)])[0]
        table.blocks.unpersist()
        return Fitted(partial(table.predict, ensemble=model), model)


def gradient_boosting(
    depth: int, rate: float, trees: int, subsample: float = 1.0, columns: float = 1.0,
    seed: int = 1, patience: int | None = None, leaky: DataFrame | None = None,
) -> BoostedFit:
    return BoostedFit(Boosting(depth, rate, trees, subsample, columns, seed=seed, patience=patience), leaky)


def forest(trees: int, depth: int = 30, seed: int = SEED):
    return _fit_trees(
        RandomForestRegressor(
            numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", bootstrap=True, seed=seed
        )
    )


@dataclass
class ExtraFit:
    """Extremely random trees by ``models.forests``; scorers grow those of all masks and folds side by side."""

    settings: Forest

    def __call__(self, train: DataFrame, features: list[str], target: str) -> Fitted:
        table = binned(train, features, target, bins=None)
        model = grow_forests(table, [Fit(tuple(range(len(features))), self.settings)])[0]
        table.blocks.unpersist()
        return Fitted(partial(table.predict, ensemble=model), model)


def extra_trees(trees: int, depth: int = 30, leaf_rows: int = 1, seed: int = SEED) -> ExtraFit:
    """Every tree sees all rows; each node draws one threshold per feature and takes the best."""
    return ExtraFit(Forest(trees, depth, leaf_rows, seed))


def weighted_median(values: list[Column], weights: list[float]) -> Column:
    """The smallest value at which the running weight reaches half of the total."""
    pairs = F.array_sort(F.array(*[F.struct(v.alias("v"), F.lit(w).alias("w")) for v, w in zip(values, weights)]))
    half = sum(weights) / 2
    start = F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("double").alias("v"))
    return F.aggregate(
        pairs,
        start,
        lambda acc, p: F.struct(
            (acc["seen"] + p["w"]).alias("seen"),
            F.when(acc["v"].isNull() & (acc["seen"] + p["w"] >= half), p["v"]).otherwise(acc["v"]).alias("v"),
        ),
        lambda acc: acc["v"],
    )


def ada_boost(
    rounds: int = 50, rate: float = 1.0, depth: int = 3, seed: int = SEED, write_every: int = 4
):
    """AdaBoost.R2 with linear loss: row weights instead of resampling, weighted median.

    Weights are recomputed from the last few trees and written every ``write_every`` rounds.
    """

    def fit(train: DataFrame, features: list[str], target: str) -> Fitted:
        vectors = _assembled(features)
        data = vectors.transform(train).select(_VECTOR, F.col(target).cast("double").alias("_y"))
        data = materialize(data.withColumn("_w", F.lit(1.0)), "ada")
        models, votes = [], []
        for r in range(rounds):
            tree = DecisionTreeRegressor(
                featuresCol=_VECTOR, labelCol="_y", weightCol="_w", maxDepth=depth, seed=seed + r
            )
            model = tree.fit(data)
            away = F.abs(F.col("_y") - F.col("prediction"))
            scored = model.transform(data).withColumn("_away", away)
            # Weights are left unnormalised: only their shares enter.
            worst, far, weight = scored.agg(
                F.max("_away"), F.sum(F.col("_w") * F.col("_away")), F.sum("_w")
            ).first()
            if not worst:
                models.append(model)
                votes.append(1.0)
                break
            loss = far / weight / worst
            if loss >= 0.5:
                if not models:
                    models.append(model)
                    votes.append(1.0)
                break
            beta = loss / (1.0 - loss)
            models.append(model)
            votes.append(rate * math.log(1.0 / beta))
            if r + 1 < rounds:
                grown = F.col("_w") * F.pow(F.lit(beta), rate * (1 - F.col("_away") / worst))
                data = scored.select(_VECTOR, "_y", grown.alias("_w"))
                if r % write_every == write_every - 1:
                    data = materialize(data, "ada")

        def predict(df: DataFrame) -> DataFrame:
            scored, columns = vectors.transform(df), []
            for i, model in enumerate(models):
                columns.append(f"_p{i}")
                scored = model.copy({model.predictionCol: columns[-1]}).transform(scored)
            median = weighted_median([F.col(c) for c in columns], votes)
            return scored.withColumn("prediction", median).drop(_VECTOR, *columns)

        return Fitted(predict, models)

    return fit


@dataclass
class MomentFit:
    """A linear learner that needs only the sums of products of the training rows.

    Layers solve many such learners and folds from the moments of one scan.
    """

    solve: Callable[[Moments, list[int]], tuple[float, np.ndarray]]
    columns: int | None = None  # at most so many columns, drawn at random
    seed: int = SEED

    def names(self, features: list[str]) -> list[str]:
        if self.columns is None or len(features) <= self.columns:
            return features
        return random.Random(self.seed).sample(features, self.columns)

    def __call__(self, train: DataFrame, features: list[str], target: str) -> Fitted:
        names = self.names(features)
        moments = fold_moments(train, names, target)[0]
        intercept, coef = self.solve(moments, list(range(len(names))))
        value = linear_prediction(names, intercept, coef)
        return Fitted(lambda df: df.withColumn("prediction", value), (intercept, dict(zip(names, coef))))


def elastic_net(alpha: float = 1.0, l1_ratio: float = 0.5) -> MomentFit:
    """Both penalties on the coefficients; solved on sums of products at any number of features."""
    return MomentFit(partial(gram.elastic_net, alpha=alpha, l1_ratio=l1_ratio))


def naive_bayes(kind: str, smoothing: float = 1.0):
    """Every distinct target value is a class, and classes are a table: there may be as many as rows."""

    def fit(train: DataFrame, features: list[str], target: str) -> Fitted:
        fitted = class_table(train, features, target, kind, smoothing)
        return Fitted(lambda df: predict_class(df, fitted, features), fitted)

    return fit


# The settings of every catalogued learner. "ardr" is left out by default.
SETTINGS: dict[str, tuple[Callable, dict]] = {
    "lgbm": (gradient_boosting, dict(depth=5, rate=0.1, trees=100, subsample=0.9, columns=0.9, seed=1, patience=10)),
    "adaboost": (ada_boost, dict(rounds=50, rate=1.0, depth=3)),
    "extratrees": (extra_trees, dict(trees=200)),
    "xgboost": (gradient_boosting, dict(depth=6, rate=0.07, trees=800, subsample=0.75, columns=0.7, seed=1440, patience=20)),
    "bagging": (forest, dict(trees=10)),
    "ardr": (MomentFit, dict(solve=relevance_regression, columns=100)),
    "bayesridge": (MomentFit, dict(solve=bayesian_ridge)),
    "elasticnet": (elastic_net, dict(alpha=1.0, l1_ratio=0.5)),
    "randomforest": (forest, dict(trees=200)),
    "gradientboosting": (gradient_boosting, dict(depth=3, rate=0.1, trees=200)),
    "multinomial": (naive_bayes, dict(kind="multinomial", smoothing=1.0)),
    "gaussiannb": (naive_bayes, dict(kind="gaussian")),
    "linear": (MomentFit, dict(solve=least_squares)),
}
OPT_IN = ("ardr",)


def learner(name: str, **changes) -> Learner:
    """A catalogued learner; ``changes`` replace single settings."""
    build, settings = SETTINGS[name]
    return Learner(name, build(**{**settings, **changes}))


def catalogue(changes: dict[str, dict] | None = None) -> dict[str, Learner]:
    named = changes or {}
    return {n: learner(n, **named.get(n, {})) for n in SETTINGS if n not in OPT_IN or n in named}


def bake_off(
    train: DataFrame,
    test: DataFrame,
    features: list[str],
    target: str,
    learners: dict[str, Learner],
    jobs: int = JOBS,
) -> DataFrame:
    """Fit every learner on ``train`` and report its errors on ``test``, one row each."""
    train, test = materialize(train, "train"), materialize(test, "test")
    boosted = [name for name, one in learners.items() if isinstance(one.fit, BoostedFit) and one.fit.leaky is None]
    others = [name for name in learners if name not in boosted]
    fitted = dict(zip(others, side_by_side([partial(learners[n].fit, train, features, target) for n in others], jobs)))
    if boosted:  # side by side, in one set of scans
        table = binned(train, features, target)
        fits = [Fit(tuple(range(len(features))), learners[n].fit.settings, watch=learners[n].fit.watch) for n in boosted]
        for name, model in zip(boosted, grow(table, fits)):
            fitted[name] = Fitted(partial(table.predict, ensemble=model), model)
        table.blocks.unpersist()
    report = None
    for name in learners:
        scored = fitted[name].predict(test)
        row = regression_report(scored, target).withColumn("learner", F.lit(name))
        report = row if report is None else report.unionByName(row)
    return report.select("learner", "rows", "mean_residual", "mae", "mse", "rmse", "r2")
