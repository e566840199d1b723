"""Boosted trees with patience, cross-validated rounds, split counts and staged tuning."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurelab.functions.draws import SEED, uniform
from featurelab.models.trees import HOLD_OUT, Boosting, Ensemble, Fit, binned, grow, stop_round
from featurelab.operators.metrics import accuracy, roc_auc

# The classifier's boosting rounds without gain before it stops.
CLASSIFIER_PATIENCE = 50

# The tuning guide's starting point and ranges.
START_RATE = 0.1
RATES = [0.05, 0.1, 0.2]
TREES = [40, 50, 60, 70]
DEPTHS = [5, 6, 7, 8]
SPLIT_SHARES = [0.005, 0.01]
LEAF_ROWS = 50
START_DEPTH = 8
START_SPLIT_SHARE = 0.005
SUBSAMPLE = 0.8
SLOWER = [2, 5]


def hold_out(df: DataFrame, share: float = HOLD_OUT, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(train, valid): rows drawn by a hash of their content, so copies stay on one side."""
    draw = uniform(F.xxhash64(*df.columns), "hold-out", seed=seed)
    return df.filter(draw >= share), df.filter(draw < share)


def fit_with_patience(
    estimator: GBTRegressor, train: DataFrame, valid: DataFrame, patience: int, loss: str = "absolute"
):
    """Boost until ``patience`` rounds bring no gain on ``valid``, keeping the best round.

    The rounds double from fit to fit, so the work is at most about twice that of the last
    one; the same seed grows the same first trees. MLlib's own stopping has no patience.
    """
    limit = estimator.getMaxIter()
    rounds = min(limit, 2 * patience)
    while True:
        model = estimator.copy({estimator.maxIter: rounds}).fit(train)
        errors = model.evaluateEachIteration(valid, loss)
        best = stop_round(errors, patience)
        if best is None and rounds < limit:
            rounds = min(limit, 2 * rounds)
            continue
        if best is None:
            best = errors.index(min(errors)) + 1
        return model if best == rounds else estimator.copy({estimator.maxIter: best}).fit(train)


@dataclass
class TunedClassifier:
    model: Ensemble
    rounds: int
    curve: DataFrame  # (round, auc, folds)
    report: DataFrame  # (rows, accuracy, auc) on the training rows


def settings_of(estimator: GBTClassifier) -> Boosting:
    """The settings of an MLlib estimator, for trees grown here."""
    return Boosting(
        estimator.getMaxDepth(), estimator.getStepSize(), estimator.getMaxIter(), estimator.getSubsamplingRate(),
        leaf_rows=estimator.getMinInstancesPerNode(), loss="logistic", seed=estimator.getSeed() & 0xFFFFFFFF,
    )


def fit_classifier(
    df: DataFrame,
    features: list[str],
    label: str,
    settings: Boosting | GBTClassifier,
    fold: str | None = None,
    patience: int = CLASSIFIER_PATIENCE,
) -> TunedClassifier:
    """Choose the number of rounds by cross-validated AUC and report on all rows.

    The fits of all folds and the one of all rows grow together; once ``patience`` rounds bring no gain in
    the mean AUC of the folds, growth stops and the best round is kept. Without a fold column all rounds
    of the settings are grown. Rows with a NULL are left out.
    """
    settings = settings if isinstance(settings, Boosting) else settings_of(settings)
    settings = replace(settings, loss="logistic", patience=patience if fold else None)
    df = df.na.drop(subset=[f"`{c}`" for c in [*features, label]])
    table, every = binned(df, features, label, fold), tuple(range(len(features)))
    tested = [Fit(every, settings, k, "test") for k in table.folds] if fold else []
    *per_fold, model = grow(table, [*tested, Fit(every, settings)], joint=bool(fold))
    table.blocks.unpersist()
    rows = [
        (i, -float(np.mean(errors)) if np.isfinite(errors).all() else None, int(np.isfinite(errors).sum()))
        for i, errors in enumerate(zip(*[e.errors for e in per_fold]), start=1)
    ]
    curve = df.sparkSession.createDataFrame(rows, "round int, auc double, folds bigint")
    last = table.predict(df.select(*[F.col(f"`{c}`") for c in features], F.col(label).alias("label")), model, "margin")
    auc = roc_auc(last, "label", "margin").select("auc").scalar()
    report = last.agg(
        F.count(F.lit(1)).alias("rows"),
        accuracy(F.col("label"), (F.col("margin") > 0).cast("double")).alias("accuracy"),
    ).withColumn("auc", auc)
    return TunedClassifier(model, len(model.trees), curve, report)


def split_counts(spark: SparkSession, model: Ensemble, features: list[str]) -> DataFrame:
    """How many splits use each feature, most used first."""
    used = np.bincount([f for tree in model.trees for f in tree.feature if f >= 0], minlength=len(features))
    rows = sorted(zip(features, used.tolist()), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, splits bigint")


def tune_in_stages(
    df: DataFrame,
    features: list[str],
    target: str,
    fold: str,
    classify: bool = True,
    rates: list[float] | None = None,
    trees: list[int] | None = None,
    depths: list[int] | None = None,
    split_shares: list[float] | None = None,
    slower: list[int] | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Staged search: learning rate and number of trees; then depth and rows per node; then
    a lower rate with proportionally more trees. Returns every setting tried with its metric.

    The best setting of a stage is the start of the next. All settings and folds of a stage grow together,
    and settings that differ in their number of trees alone share their trees.
    """
    table, every = binned(df, features, target, fold), tuple(range(len(features)))
    rows = int(table.total(table.blocks, _count_rows)[0])
    few = max(1, min(LEAF_ROWS, int(rows * START_SPLIT_SHARE)))
    start = Boosting(
        START_DEPTH if depths is None else max(depths), START_RATE, (trees or TREES)[0], SUBSAMPLE,
        columns=len(features) ** -0.5, leaf_rows=few, loss="logistic" if classify else "squared", seed=seed,
    )
    metric_name, better = ("areaUnderROC", max) if classify else ("mae", min)
    tried: list[tuple] = []

    def stage(number: int, grid: list[Boosting]) -> Boosting:
        # The errors after every round are known, so one fit serves all settings with fewer trees.
        longest = {replace(s, trees=0): max(o.trees for o in grid if replace(o, trees=0) == replace(s, trees=0)) for s in grid}
        fits = [Fit(every, replace(s, trees=n), k, "test") for s, n in longest.items() for k in table.folds]
        grown = {(replace(e.fit.settings, trees=0), e.fit.test): e.errors for e in grow(table, fits)}
        scores = []
        for s in grid:
            errors = [grown[replace(s, trees=0), k][s.trees - 1] for k in table.folds]
            scores.append(float(-np.mean(errors) if classify else np.mean(errors)))
            tried.append((number, s.rate, s.trees, s.depth, s.leaf_rows, scores[-1]))
        return grid[scores.index(better(scores))]

    best = stage(1, [replace(start, rate=r, trees=t) for r in rates or RATES for t in trees or TREES])
    shares = sorted(set(split_shares or SPLIT_SHARES))
    best = stage(2, [replace(best, depth=d, leaf_rows=max(1, int(rows * s))) for d in depths or DEPTHS for s in shares])
    stage(3, [replace(best, rate=best.rate / s, trees=best.trees * s) for s in [1, *(slower or SLOWER)]])
    table.blocks.unpersist()
    schema = "stage int, rate double, trees int, depth int, node_rows long, " + f"{metric_name} double"
    return df.sparkSession.createDataFrame(tried, schema)


def _count_rows(part):
    yield np.array([sum(block.target.size for block in part)], dtype=float)
