"""Metrics, cross-validated mask scores, learners and the feature search."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import functions as F

from featurelab.functions.genes import random_genome
from featurelab.models import boosting, layers, learners
from featurelab.models.gram import bayesian_ridge, fold_moments, least_squares, linear_prediction, relevance_regression
from featurelab.models.trees import Boosting
from featurelab.models.masks import LearnerScorer, LinearScorer, score_masks, search_masks
from featurelab.models.wide import out_of_fold, wide_least_squares, wide_moments
from featurelab.operators import folds, metrics
from featurelab.operators.encode import feature_vector
from featurelab.operators import population as pop
from featurelab.plans.fixtures import (
    GENES, GENOMES, ORDER_CLASSES, ORDER_FACTS, ORDER_FEATURES, folded, genomes, order_classes, order_facts,
    rounded, sql_bits, sql_digest, sql_draw, sql_int,
)
from featurelab.plans import mask_sql
from featurelab.plans.genetic import SETTINGS_SQL, sql_names
from featurelab.plans.profiling import sql_folds
from featurelab.sources.tables import load_model, load_solutions, read_table, save_model, save_solutions
from featurelab.sources.work import materialize, new_path

QUERIES, ORACLE = {}, {}

_FOLDS = 3


def _prepared(spark, sf):
    return folded(order_facts(spark, sf), _FOLDS)


def regression_metrics(spark, sf):
    facts = order_facts(spark, sf).withColumn("prediction", F.col("price") * 0.95)
    report = metrics.regression_report(facts)
    numbers = ["mean_residual", "mae", "mse", "rmse", "r2"]
    return report.select("rows", *[rounded(c).alias(c) for c in numbers])


def regression_metrics_by_size(spark, sf):
    facts = order_facts(spark, sf).withColumn("prediction", F.col("price") * 0.95)
    report = metrics.regression_report(facts, by=["n"])
    return report.select(F.col("n").cast("bigint"), "rows", rounded("mae").alias("mae"), rounded("mse").alias("mse"))


def _probabilities(spark, sf):
    """A monotone score as probability, and three classes by size with their probabilities."""
    price = F.col("price")
    classes = order_classes(spark, sf).withColumn("p", price / (price + 105.0))
    size = F.when(F.col("y") > 200, 2).when(F.col("y") > 100, 1).otherwise(0)
    return classes.withColumns(
        {"size": size, "ps": F.array((1 - F.col("p")) * (1 - F.col("p")), 2 * F.col("p") * (1 - F.col("p")), F.col("p") * F.col("p"))}
    )


def classification_metrics(spark, sf):
    scored = _probabilities(spark, sf)
    predicted = (F.col("p") > 0.5).cast("int")
    sized = F.when(F.col("price") > 210, 2).when(F.col("price") > 105, 1).otherwise(0)
    return scored.agg(
        rounded(metrics.accuracy(F.col("label"), predicted), 6).alias("accuracy"),
        rounded(metrics.error_rate(F.col("label"), predicted), 6).alias("error"),
        rounded(metrics.error_rate(F.col("size"), sized), 6).alias("merror"),
        rounded(metrics.log_loss(F.col("label"), F.col("p")), 6).alias("logloss"),
        rounded(metrics.multiclass_log_loss(F.col("size"), F.col("ps")), 6).alias("mlogloss"),
    )


def roc_auc(spark, sf):
    """Price is rounded so that many scores tie."""
    scored = order_classes(spark, sf).withColumn("score", F.round("price", 0))
    return metrics.roc_auc(scored, "label", "score").select(rounded("auc", 8).alias("auc"))


def roc_auc_by_size(spark, sf):
    scored = order_classes(spark, sf).withColumns({"score": F.round("qty", 0), "size": F.col("n").cast("bigint")})
    return metrics.roc_auc(scored, "label", "score", ["size"]).select("size", rounded("auc", 8).alias("auc"))


_SINGLE = ["".join("1" if i == j else "0" for j in range(len(ORDER_FEATURES))) for i in range(len(ORDER_FEATURES))]


def single_feature_scores(spark, sf):
    scorer = LinearScorer(_prepared(spark, sf), ORDER_FEATURES, "y")
    scorer.score(_SINGLE)
    return scorer.scores().withColumn("score", rounded("score", 6))


_PAIRS = [
    "".join("1" if k in (i, j) else "0" for k in range(len(ORDER_FEATURES)))
    for i in range(len(ORDER_FEATURES)) for j in range(i + 1, len(ORDER_FEATURES))
]


def _pair_scores(metric):
    def query(spark, sf):
        """All masks of two features under a squared error."""
        scorer = LinearScorer(_prepared(spark, sf), ORDER_FEATURES, "y", metric=metric, clip_negative=False)
        scorer.score(_PAIRS)
        return scorer.scores().withColumn("score", rounded("score", 4))

    return query


def mask_scores(spark, sf):
    """Every genome of the customers' populations, read as a mask over the order features."""
    masks = genomes(spark, sf).select("run_id", "idx", F.substring("genome", 1, len(ORDER_FEATURES)).alias("genome"))
    scorer = LinearScorer(_prepared(spark, sf), ORDER_FEATURES, "y", max_features=7)
    return scorer(masks).select("run_id", "idx", "genome", rounded("score", 6).alias("score"))


def tree_mask_scores(spark, sf):
    """All masks of one or two features under gradient boosting, with half the catalogued trees."""
    one = learners.learner("gradientboosting", trees=100)
    return score_masks(_prepared(spark, sf), [*_SINGLE, *_PAIRS], one, ORDER_FEATURES, "y")


def tree_feature_search(spark, sf):
    """A search whose masks are scored by boosted trees of depth 3, one run of ten per 100 suppliers."""
    one = learners.learner("gradientboosting", trees=20)
    scorer = LearnerScorer(_prepared(spark, sf), one, ORDER_FEATURES, "y")
    group = F.floor(F.col("s_suppkey") / 100).cast("bigint")
    runs = read_table(spark, sf, "supplier").select(group.alias("run_id")).distinct().withColumns(
        {"n": F.lit(10), "pc": F.lit(0.22), "pm": F.lit(0.1)}
    )
    found = search_masks(runs, scorer, ORDER_FEATURES, 2)
    return found.select("run_id", F.col("idx").cast("bigint"), "genome", "score")


_BANDS = {"n": "n", "qty_band": "floor(qty / 15)", "price_band": "floor(price / 30)", "disc_band": "floor(disc * 317.31 + 0.123)"}
_STUMP_TREES = 20


def _banded(spark, sf):
    facts = _prepared(spark, sf)
    return facts.select("row_id", "fold", "y", *[F.expr(f"cast({e} as double)").alias(c) for c, e in _BANDS.items()])


def stump_mask_scores(spark, sf):
    """Masks of one feature in few bands, under boosted trees of depth 1."""
    genomes = ["".join("1" if i == j else "0" for j in range(len(_BANDS))) for i in range(len(_BANDS))]
    one = learners.learner("gradientboosting", depth=1, trees=_STUMP_TREES)
    return score_masks(_banded(spark, sf), genomes, one, list(_BANDS), "y").withColumn("score", rounded("score", 6))


_DRAWN_TREES = 200


def drawn_stump_scores(spark, sf):
    """Every mask of one feature under 200 extremely random trees of depth 1."""
    one = learners.learner("extratrees", trees=_DRAWN_TREES, depth=1)
    return score_masks(_prepared(spark, sf), _SINGLE, one, ORDER_FEATURES, "y").withColumn("score", rounded("score", 6))


def stump_search(spark, sf):
    """Searches over the banded features, at most one to a mask, whose scores are those of boosted stumps."""
    one = learners.learner("gradientboosting", depth=1, trees=_STUMP_TREES)
    scorer = LearnerScorer(_banded(spark, sf), one, list(_BANDS), "y", max_features=1)
    runs = read_table(spark, sf, "supplier").groupBy(F.floor(F.col("s_suppkey") / 50).cast("bigint").alias("run_id")).agg(
        F.count(F.lit(1)).cast("int").alias("n")
    ).withColumns({"pc": F.lit(0.22), "pm": F.lit(0.1)})
    found = search_masks(runs, scorer, list(_BANDS), _SEARCH_ITERATIONS)
    return found.select("run_id", F.col("idx").cast("bigint"), "genome", rounded("score", 6).alias("score"))


def stump_curve(spark, sf):
    """AUC per round of boosted stumps on one feature, until the patience of 50 rounds has run out."""
    settings = Boosting(depth=1, rate=0.3, trees=200)
    tuned = boosting.fit_classifier(_classes(spark, sf), ["n"], "label", settings, "fold")
    return tuned.curve.select("round", rounded("auc", 6).alias("auc"), "folds")


_SEARCH_ITERATIONS = 5


def feature_search(spark, sf):
    """One search per 50 suppliers, each over the masks of the order features."""
    scorer = LinearScorer(_prepared(spark, sf), ORDER_FEATURES, "y")
    group = F.floor(F.col("s_suppkey") / 50).cast("bigint")
    runs = read_table(spark, sf, "supplier").groupBy(group.alias("run_id")).agg(
        F.count(F.lit(1)).cast("int").alias("n")
    ).withColumns({"pc": F.lit(0.22), "pm": F.lit(0.1)})
    found = search_masks(runs, scorer, ORDER_FEATURES, _SEARCH_ITERATIONS)
    named = pop.with_features(found, ORDER_FEATURES, [])
    return named.select(
        "run_id", F.col("idx").cast("bigint"), "genome", rounded("score", 6).alias("score"),
        F.array_join("baseline_features", ",").alias("features"),
    )


_BASELINE = ["n", "price", "tax"]
_OUTPUTS = {"linear_N_0_M_0": "qty", "linear_N_0_M_1": "disc"}


def output_feature_search(spark, sf):
    """Searches over baseline features and the out-of-fold outputs of a layer trained before."""
    facts, one = _prepared(spark, sf), learners.learner("linear")
    neurons = [layers.Neuron(name, 0, one, [feature], []) for name, feature in _OUTPUTS.items()]
    outputs = layers.train_layers(facts, neurons, _FOLDS)
    table = materialize(layers.neuron_inputs(facts, outputs, _BASELINE, list(_OUTPUTS)), "inputs")
    names = [*_BASELINE, *_OUTPUTS]
    group = F.floor(F.col("s_suppkey") / 50).cast("bigint")
    runs = read_table(spark, sf, "supplier").groupBy(group.alias("run_id")).agg(
        F.count(F.lit(1)).cast("int").alias("n")
    ).withColumns({"pc": F.lit(0.22), "pm": F.lit(0.1)})
    scorer = LinearScorer(table, names, "y")
    found = search_masks(runs, scorer, _BASELINE, _SEARCH_ITERATIONS, exmodel=list(_OUTPUTS))
    named = pop.with_features(found, _BASELINE, list(_OUTPUTS))
    return named.select(
        "run_id", F.col("idx").cast("bigint"), "genome", rounded("score", 6).alias("score"),
        F.array_join("baseline_features", ",").alias("features"), F.array_join("exmodel_features", ",").alias("outputs"),
    )


def settings_sweep_masks(spark, sf):
    """Settings read from the suppliers' draws, each scored by a feature search under them."""
    scorer = LinearScorer(_prepared(spark, sf), ORDER_FEATURES, "y")
    settings = read_table(spark, sf, "supplier").select(random_genome(GENES, F.col("s_suppkey"), "settings").alias("genome"))
    swept = pop.sweep_settings(
        settings, len(ORDER_FEATURES), max_iterations=2, score=scorer, best_possible=0.0, cut_every=1
    )
    return swept.withColumns({c: rounded(c, 6) for c in ["pc", "pm", "best_found", "score"]})


_OWN = 5  # baseline features of the memo query; the others stand for outputs of earlier models


def search_solutions(spark, sf):
    """The memo of a short search with chromosomes and features, saved and restored."""
    scorer = LinearScorer(_prepared(spark, sf), ORDER_FEATURES, "y", exmodel=ORDER_FEATURES[_OWN:])
    runs = read_table(spark, sf, "supplier").groupBy(F.floor(F.col("s_suppkey") / 20).cast("bigint").alias("run_id")).agg(
        F.count(F.lit(1)).cast("int").alias("n")
    ).withColumns({"pc": F.lit(0.22), "pm": F.lit(0.1)})
    search_masks(runs, scorer, ORDER_FEATURES, 2)
    path = new_path(spark, "solutions")
    save_solutions(scorer.solutions(), path)
    return load_solutions(spark, path).select(
        "genome", "baseline_genes", "exmodel_genes", rounded("score", 6).alias("score"),
        *[F.array_join(f"{part}_features", ",").alias(f"{part}_features") for part in ("baseline", "exmodel")],
    )


def least_squares_fit(spark, sf):
    """Coefficients of the target on price: slope, intercept and training error."""
    facts = materialize(order_facts(spark, sf), "facts")
    intercept, coef = least_squares(fold_moments(facts, ["price"], "y")[0], [0])
    value = linear_prediction(["price"], intercept, coef)
    error = facts.agg(rounded(metrics.mae(F.col("y"), value), 6).alias("mae"))
    return error.withColumns(
        {"intercept": rounded(F.lit(intercept), 6), "slope": rounded(F.lit(float(coef[0])), 6)}
    )


def evidence_fits(spark, sf):
    """Bayesian ridge and relevance regression on one feature at a time, whose iterations unroll."""
    facts = materialize(order_facts(spark, sf), "facts")
    moments = fold_moments(facts, ORDER_FEATURES, "y")[0]
    fits = [
        (name, feature, *(float(x) for x in (intercept, coef[0])))
        for name, solve in [("bayesridge", bayesian_ridge), ("ardr", relevance_regression)]
        for i, feature in enumerate(ORDER_FEATURES)
        for intercept, coef in [solve(moments, [i])]
    ]
    found = spark.createDataFrame(fits, "learner string, feature string, intercept double, slope double")
    return found.withColumns({c: rounded(c, 5) for c in ("intercept", "slope")})


_DAYS = 366


def _day_fits(spark, sf):
    """Lines with a dummy for every day of the year but the first, and the fits of quantity without each fold."""
    lines = read_table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % _FOLDS).cast("int").alias("fold"), F.col("l_quantity").alias("y"), F.dayofyear("l_shipdate").alias("day")
    )
    day, none = F.col("day"), F.array().cast("array<int>")
    slots = F.when(day > 1, F.array(day - 2)).when(day == 1, none)  # NULL for a NULL day, as its dummies
    ones = F.when(day > 1, F.array(F.lit(1.0))).when(day == 1, none.cast("array<double>"))
    lines = materialize(lines.withColumn("x", F.struct(slots.alias("indices"), ones.alias("values"))), "lines")
    moments = wide_moments(lines, "x", _DAYS - 1, "y", "fold")
    return lines, moments.folds, wide_least_squares(moments)


def wide_fold_scores(spark, sf):
    """Error of every fold under the fit that left it out."""
    lines, held, fits = _day_fits(spark, sf)
    scored = out_of_fold(lines.select("fold", "y", "x"), "x", "fold", held, fits)
    return scored.groupBy(F.col("fold").cast("bigint").alias("fold")).agg(
        F.count(F.lit(1)).alias("rows"), rounded(metrics.mae(F.col("y"), F.col("prediction")), 5).alias("mae")
    )


def wide_fold_fits(spark, sf):
    """Quantity by day of the year, fitted without each fold by blocks of sums."""
    lines, held, found = _day_fits(spark, sf)
    fits = [
        (k, day, float(intercept + (coef[day - 2] if day > 1 else 0.0)))
        for k, (intercept, coef) in zip(held, found)
        for day in range(1, _DAYS + 1)
    ]
    fits = spark.createDataFrame(fits, "fold bigint, day bigint, prediction double")
    others = F.transform(F.sequence(F.lit(1), F.lit(_FOLDS - 1)), lambda i: (F.col("fold") + i) % _FOLDS)
    seen = lines.select(F.explode(others).alias("fold"), "day").distinct()  # days the fit has learned from
    # Fits are off by some 1e-11: a mean half way between two results is seen as one.
    return fits.join(seen, ["fold", "day"], "left_semi").withColumn("prediction", rounded(F.round("prediction", 10), 5))


def model_restore(spark, sf):
    """Predictions of a linear model that was saved and loaded."""
    facts = materialize(order_facts(spark, sf), "facts")
    vectors = feature_vector(facts, ["qty"])
    path = new_path(spark, "model")
    save_model(LinearRegression(labelCol="y").fit(vectors), path)
    scored = load_model(LinearRegressionModel, path).transform(vectors)
    return scored.select("row_id", rounded("prediction", 6).alias("prediction"))


def elastic_mask_scores(spark, sf):
    """Every mask of one feature under the elastic net as catalogued, whose fit on one feature has a closed form."""
    scorer = LinearScorer(_prepared(spark, sf), ORDER_FEATURES, "y", learner=learners.learner("elasticnet"))
    scorer.score(_SINGLE)
    return scorer.scores().withColumn("score", rounded("score", 6))


def elastic_net_fit(spark, sf):
    """Predictions of an elastic net on one feature, which has a closed form."""
    facts = materialize(order_facts(spark, sf), "facts")
    scored = learners.learner("elasticnet").fit(facts, ["price"], "y").predict(facts)
    return scored.select("row_id", rounded("prediction", 3).alias("prediction"))


_TARGET_FEATURES = ["qty", "price", "disc", "tax"]
# Fewer than catalogued: boosting with this target goes on for hundreds of rounds of up to six scans each,
# bagged trees are MLlib's, and AdaBoost's are one fit after the other.
_FEWER = {
    "lgbm": dict(trees=20), "xgboost": dict(trees=20), "gradientboosting": dict(trees=20),
    "adaboost": dict(rounds=4), "extratrees": dict(trees=50, depth=8), "randomforest": dict(trees=5, depth=8),
    "bagging": dict(trees=3, depth=8),
}


def learner_bake_off(spark, sf):
    """All learners on a 67/33 split, predicting the number of lines; fewer trees than catalogued."""
    split = folds.train_test_split(order_facts(spark, sf), "row_id")
    train, test = split.filter(F.col("part") == "train"), split.filter(F.col("part") == "test")
    return learners.bake_off(train, test, _TARGET_FEATURES, "n", learners.catalogue({**_FEWER, "ardr": {}}))


def _bayes(kind):
    def query(spark, sf):
        """Each order's number of lines, predicted from its sums by naive Bayes."""
        facts = materialize(order_facts(spark, sf), "facts")
        scored = learners.learner(kind).fit(facts, _TARGET_FEATURES, "n").predict(facts)
        return scored.select("row_id", "prediction")

    return query


_BUYER_FEATURES = ["qty", "price"]


def customer_classes(spark, sf):
    """The customer of each order, guessed from its sums by Gaussian naive Bayes: as many classes as customers."""
    buyers = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").cast("double").alias("buyer"))
    facts = materialize(order_facts(spark, sf).join(buyers, "row_id"), "buyers")
    scored = learners.learner("gaussiannb").fit(facts, _BUYER_FEATURES, "buyer").predict(facts)
    return scored.select("row_id", F.col("prediction").cast("bigint").alias("buyer"))


_CLASS_FEATURES = ["n", "disc", "tax", "z1", "z2"]


def _classes(spark, sf):
    return folded(order_classes(spark, sf), _FOLDS)


# Depth and rate of the tuned classifier; its patience of 50 ends it, not the number of trees.
_CLASSIFIER = Boosting(depth=3, rate=0.1, trees=1000, seed=27)


def boosted_classifier(spark, sf):
    """Accuracy and AUC after choosing the number of rounds by cross-validation."""
    return boosting.fit_classifier(_classes(spark, sf), _CLASS_FEATURES, "label", _CLASSIFIER, "fold").report


def round_curve(spark, sf):
    return boosting.fit_classifier(_classes(spark, sf), _CLASS_FEATURES, "label", _CLASSIFIER, "fold").curve


def split_counts(spark, sf):
    tuned = boosting.fit_classifier(_classes(spark, sf), _CLASS_FEATURES, "label", _CLASSIFIER, "fold")
    return boosting.split_counts(spark, tuned.model, _CLASS_FEATURES)


def early_stopping(spark, sf):
    """Rounds kept by boosting as catalogued: patience 20 of at most 800."""
    facts = materialize(order_facts(spark, sf), "facts")
    fitted = learners.learner("xgboost").fit(facts, ["n", "qty", "disc"], "y")
    return metrics.regression_report(fitted.predict(facts)).withColumn("rounds", F.lit(len(fitted.model.trees)).cast("bigint"))


def staged_tuning(spark, sf):
    """All three stages, with fewer trees than the tuning guide's."""
    return boosting.tune_in_stages(
        _classes(spark, sf), _CLASS_FEATURES, "label", "fold", rates=[0.1, 0.2], trees=[10, 15], depths=[3, 5], slower=[2],
    )


QUERIES.update(
    regression_metrics=regression_metrics, regression_metrics_by_size=regression_metrics_by_size,
    classification_metrics=classification_metrics, roc_auc=roc_auc, roc_auc_by_size=roc_auc_by_size,
    single_feature_scores=single_feature_scores, mask_scores=mask_scores,
    tree_mask_scores=tree_mask_scores, stump_mask_scores=stump_mask_scores, drawn_stump_scores=drawn_stump_scores, stump_search=stump_search,
    stump_curve=stump_curve, feature_search=feature_search, tree_feature_search=tree_feature_search,
    settings_sweep_masks=settings_sweep_masks, search_solutions=search_solutions,
    output_feature_search=output_feature_search,
    feature_pair_scores=_pair_scores("mse"), feature_pair_rmse=_pair_scores("rmse"), multinomial_classes=_bayes("multinomial"),
    gaussian_classes=_bayes("gaussiannb"), customer_classes=customer_classes,
    model_restore=model_restore, elastic_net_fit=elastic_net_fit, elastic_mask_scores=elastic_mask_scores,
    least_squares_fit=least_squares_fit, wide_fold_fits=wide_fold_fits, wide_fold_scores=wide_fold_scores, evidence_fits=evidence_fits, learner_bake_off=learner_bake_off,
    boosted_classifier=boosted_classifier, round_curve=round_curve, split_counts=split_counts,
    early_stopping=early_stopping, staged_tuning=staged_tuning,
)

_REGRESSION = """
count(*) AS rows, round(avg(y - p), 4) AS mean_residual, round(avg(abs(y - p)), 4) AS mae,
round(avg((y - p) * (y - p)), 4) AS mse, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse,
round(1 - avg((y - p) * (y - p)) / var_pop(y), 4) AS r2"""
_AUC = """
  SELECT {by} sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc
  FROM (SELECT *, coalesce(sum(neg) OVER ({part} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
        FROM (SELECT {by} score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
              FROM scored GROUP BY ALL)) {group}"""

_SIZE = len(ORDER_FEATURES)
_FOLDED = f"{ORDER_FACTS}, b AS MATERIALIZED ({sql_folds('facts', 'row_id', _FOLDS)})"


def _sql_runs(per_run: int) -> str:
    """Searches of up to ``per_run`` suppliers each, starting from random masks."""
    total = sql_int("1001", "run_id", "idx", "'total'")
    some = sql_int(str(_SIZE + 1), "run_id", "idx", "'baseline'")
    draw = sql_draw("run_id", "idx", "'b'", "i")
    return f"""
runs AS (SELECT s_suppkey // {per_run} AS run_id, count(*) AS n FROM supplier GROUP BY 1),
people AS (SELECT run_id, idx, n, least({some}, {total}) AS wanted FROM runs, range(0, {per_run}) t(idx) WHERE idx < n),
places AS (SELECT run_id, idx, n, wanted, i, row_number() OVER (PARTITION BY run_id, idx ORDER BY {draw}, i) AS place
           FROM people, range(0, {_SIZE}) t(i)),
start AS (SELECT run_id, idx, any_value(n) AS n, 0.22 AS pc, 0.1 AS pm,
                 string_agg(CASE WHEN place <= wanted THEN '1' ELSE '0' END, '' ORDER BY i) AS genome
          FROM places GROUP BY run_id, idx)"""


def _sql_pair_scores(metric: str) -> str:
    error = "avg((y - (my + wa * (a - ma) + wb * (b - mb))) ** 2)"
    if metric == "rmse":
        error = f"sqrt({error})"
    return f"""
WITH {ORDER_FACTS}, b AS ({sql_folds("facts", "row_id", _FOLDS)}),
long AS ({" UNION ALL ".join(
    f"SELECT '{g}' AS genome, fold, {a} AS a, {c} AS b, y FROM b"
    for g, (a, c) in zip(_PAIRS, [(a, c) for i, a in enumerate(ORDER_FEATURES) for c in ORDER_FEATURES[i + 1:]]))}),
s AS (SELECT genome, k, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_,
             avg(a) AS ma, avg(b) AS mb, avg(y) AS my
      FROM long, range(0, {_FOLDS}) t(k) WHERE fold <> k GROUP BY genome, k),
w AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS wa, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM s),
e AS (SELECT l.genome, k, {error} AS e
      FROM long l JOIN w ON l.genome = w.genome AND l.fold = w.k GROUP BY l.genome, k)
SELECT genome, round(-avg(e) - 0.00002, 4) AS score FROM e GROUP BY genome"""


def _sql_output_search(per_run: int, count: int) -> str:
    """Searches over the baseline features and the outputs of the first layer."""
    names, base, more = [*_BASELINE, *_OUTPUTS], len(_BASELINE), len(_OUTPUTS)
    total = sql_int("1001", "run_id", "idx", "'total'")
    some = sql_int(str(base + 1), "run_id", "idx", "'baseline'")
    fits = ", ".join(
        f"regr_slope(y, {c}) AS s_{c}, regr_intercept(y, {c}) AS i_{c}" for c in _OUTPUTS.values()
    )
    wide = ", ".join(f"i_{c} + s_{c} * {c} AS {name}" for name, c in _OUTPUTS.items())

    def genes(part: str, size: int, wanted: str) -> str:
        return f"""
bits_{part} AS (
  SELECT run_id, idx, string_agg(CASE WHEN place <= {wanted} THEN '1' ELSE '0' END, '' ORDER BY i) AS genes
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id, idx ORDER BY {sql_draw("run_id", "idx", f"'{part}'", "i")}, i) AS place
        FROM people, range(0, {size}) t(i)) GROUP BY run_id, idx)"""

    steps, last = mask_sql.search("start", len(names), count)
    parts = [
        _FOLDED,
        f"fits AS (SELECT k, {fits} FROM b, range(0, {_FOLDS}) t(k) WHERE fold <> k GROUP BY k)",
        f"wide AS MATERIALIZED (SELECT b.*, {wide} FROM b JOIN fits ON fold = k)",
        mask_sql.every_mask(len(names)), *mask_sql.mask_scores("wide", "masks", names, _FOLDS, 1000),
        f"runs AS (SELECT s_suppkey // {per_run} AS run_id, count(*) AS n FROM supplier GROUP BY 1)",
        f"""people AS (SELECT *, least(total - wanted, {more}) AS extra FROM (
              SELECT run_id, idx, n, {total} AS total, least({some}, {total}) AS wanted
              FROM runs, range(0, {per_run}) t(idx) WHERE idx < n))""",
        genes("b", base, "wanted"), genes("x", more, "extra"),
        """start AS (SELECT run_id, idx, n, 0.22 AS pc, 0.1 AS pm, b.genes || x.genes AS genome
             FROM people JOIN bits_b b USING (run_id, idx) JOIN bits_x x USING (run_id, idx))""",
        *steps,
    ]

    def named(columns: list[str], first: int) -> str:
        picks = [f"CASE WHEN substr(genome, {first + i}, 1) = '1' THEN '{c}' END" for i, c in enumerate(columns)]
        return f"concat_ws(',', {', '.join(picks)})"

    return f"""WITH {", ".join(parts)}
SELECT run_id, idx, genome, round(score, 6) AS score, {named(_BASELINE, 1)} AS features, {named(list(_OUTPUTS), base + 1)} AS outputs
FROM {last}"""


def _sql_search(start: str, count: int, select: str) -> str:
    """A search over all masks of the order features; ``select`` reads from {last}."""
    steps, last = mask_sql.search("start", _SIZE, count)
    parts = [
        _FOLDED, mask_sql.every_mask(_SIZE), *mask_sql.mask_scores("b", "masks", ORDER_FEATURES, _FOLDS, 1000),
        start, *steps,
    ]
    return f"WITH {', '.join(parts)} {select.format(last=last)}"


ORACLE.update(
    mask_scores=f"""
WITH {_FOLDED}, {GENOMES},
people AS (SELECT run_id, idx, substr(genome, 1, {_SIZE}) AS genome FROM genomes),
{", ".join(mask_sql.mask_scores("b", "people", ORDER_FEATURES, _FOLDS, 7))}
SELECT run_id, idx, genome, round(score, 6) AS score FROM people JOIN mask_scores USING (genome)""",
    feature_search=_sql_search(
        _sql_runs(50), _SEARCH_ITERATIONS + 1,
        f"""
SELECT run_id, idx, genome, round(score, 6) AS score, {sql_names("genome", ORDER_FEATURES)} AS features FROM {{last}}""",
    ),
    search_solutions=_sql_search(
        _sql_runs(20), 3,
        f"""
SELECT DISTINCT genome, round(score, 6) AS score, substr(genome, 1, {_OWN}) AS baseline_genes, substr(genome, {_OWN} + 1) AS exmodel_genes,
       {sql_names(f"substr(genome, 1, {_OWN})", ORDER_FEATURES[:_OWN])} AS baseline_features,
       {sql_names(f"substr(genome, {_OWN} + 1)", ORDER_FEATURES[_OWN:])} AS exmodel_features
FROM (SELECT genome, score FROM ranked UNION ALL SELECT genome, score FROM children_0
      UNION ALL SELECT genome, score FROM children_1 UNION ALL SELECT genome, score FROM children_2)""",
    ),
    settings_sweep_masks=_sql_search(
        f"""
drawn AS (SELECT DISTINCT substr({sql_bits(sql_digest("s_suppkey", "'settings'"))}, 1, {GENES}) AS genome FROM supplier),
start AS (SELECT genome AS run_id, idx, substr({sql_bits(sql_digest("genome", "idx"))}, 1, {_SIZE}) AS genome, n, pc, pm
          FROM (SELECT *, {SETTINGS_SQL} FROM drawn), range(0, 32) t(idx) WHERE idx < n)""",
        3,
        """
SELECT run_id AS genome, max(n) AS n, round(max(pc), 6) AS pc, round(max(pm), 6) AS pm, round(max(score), 6) AS best_found,
       round(max(score) - 0.1::DOUBLE * 3, 6) AS score FROM {last} GROUP BY run_id""",
    ),
)
ORACLE.update(
    regression_metrics=f"WITH {ORDER_FACTS} SELECT {_REGRESSION} FROM (SELECT y, price * 0.95 AS p FROM facts)",
    regression_metrics_by_size=f"""
WITH {ORDER_FACTS}
SELECT CAST(n AS BIGINT) AS n, count(*) AS rows, round(avg(abs(y - price * 0.95)), 4) AS mae,
       round(avg((y - price * 0.95) * (y - price * 0.95)), 4) AS mse FROM facts GROUP BY n""",
    classification_metrics=f"""
WITH {ORDER_CLASSES},
s AS (SELECT label, price, price / (price + 105.0::DOUBLE) AS p,
             CASE WHEN y > 200 THEN 2 WHEN y > 100 THEN 1 ELSE 0 END AS size,
             CASE WHEN price > 210 THEN 2 WHEN price > 105 THEN 1 ELSE 0 END AS sized FROM classes)
SELECT round(avg(CAST(label = CAST(p > 0.5 AS INT) AS DOUBLE)), 6) AS accuracy,
       round(avg(CAST(label <> CAST(p > 0.5 AS INT) AS DOUBLE)), 6) AS error,
       round(avg(CAST(size <> sized AS DOUBLE)), 6) AS merror,
       round(avg(-ln(CASE WHEN label = 1 THEN p ELSE 1 - p END)), 6) AS logloss,
       round(avg(-ln(CASE size WHEN 0 THEN (1 - p) * (1 - p) WHEN 1 THEN 2 * p * (1 - p) ELSE p * p END)), 6) AS mlogloss
FROM s""",
    roc_auc=f"""
WITH {ORDER_CLASSES}, scored AS (SELECT label, round(price, 0) AS score FROM classes)
SELECT round(auc, 8) AS auc FROM ({_AUC.format(by="", part="", group="")})""",
    roc_auc_by_size=f"""
WITH {ORDER_CLASSES}, scored AS (SELECT label, round(qty, 0) AS score, CAST(n AS BIGINT) AS size FROM classes)
SELECT size, CASE WHEN isnan(auc) THEN NULL ELSE round(auc, 8) END AS auc
FROM ({_AUC.format(by="size,", part="PARTITION BY size", group="GROUP BY size")})""",
    single_feature_scores=f"""
WITH {ORDER_FACTS}, b AS ({sql_folds("facts", "row_id", _FOLDS)}),
long AS ({" UNION ALL ".join(f"SELECT '{g}' AS genome, fold, {f} AS x, y FROM b" for g, f in zip(_SINGLE, ORDER_FEATURES))}),
fits AS (SELECT genome, k, regr_slope(y, x) AS slope, regr_intercept(y, x) AS base
         FROM long, range(0, {_FOLDS}) t(k) WHERE fold <> k GROUP BY genome, k),
errors AS (SELECT l.genome, k, avg(abs(y - greatest(0, base + slope * x))) AS e
           FROM long l JOIN fits f ON l.genome = f.genome AND l.fold = f.k GROUP BY l.genome, k)
SELECT genome, round(-avg(e) - 0.00001, 6) AS score FROM errors GROUP BY genome""",
    feature_pair_scores=_sql_pair_scores("mse"), feature_pair_rmse=_sql_pair_scores("rmse"),
    output_feature_search=_sql_output_search(50, _SEARCH_ITERATIONS + 1),
    model_restore=f"""
WITH {ORDER_FACTS}, fit AS (SELECT regr_slope(y, qty) AS s, regr_intercept(y, qty) AS i FROM facts)
SELECT row_id, round(i + s * qty, 6) AS prediction FROM facts, fit""",
    elastic_net_fit=f"""
WITH {ORDER_FACTS},
m AS (SELECT avg(price) AS mx, avg(y) AS my, covar_pop(price, y) AS c, var_pop(price) AS v FROM facts),
w AS (SELECT *, sign(c) * greatest(abs(c) - 0.5, 0) / (v + 0.5) AS w FROM m)
SELECT row_id, round(my + w * (price - mx), 3) AS prediction FROM facts, w""",
    multinomial_classes=f"""
WITH {ORDER_FACTS},
c AS (SELECT n, count(*) AS rows, {", ".join(f"sum({f}) AS s_{f}" for f in _TARGET_FEATURES)} FROM facts GROUP BY n),
t AS (SELECT *, {" + ".join(f"s_{f}" for f in _TARGET_FEATURES)} + {len(_TARGET_FEATURES)} AS s FROM c),
p AS (SELECT row_id, t.n, ln(rows / (SELECT count(*) FROM facts))
             + {" + ".join(f"f.{f} * ln((s_{f} + 1) / s)" for f in _TARGET_FEATURES)} AS logp FROM facts f, t)
SELECT row_id, arg_max(n, logp) AS prediction FROM p GROUP BY row_id""",
    gaussian_classes=f"""
WITH {ORDER_FACTS},
eps AS (SELECT 1e-9 * greatest({", ".join(f"var_pop({f})" for f in _TARGET_FEATURES)}) AS e FROM facts),
c AS (SELECT n, count(*) AS rows,
             {", ".join(f"avg({f}) AS m_{f}, var_pop({f}) + any_value(e) AS v_{f}" for f in _TARGET_FEATURES)} FROM facts, eps GROUP BY n),
p AS (SELECT row_id, c.n, ln(rows / (SELECT count(*) FROM facts))
             - {" - ".join(f"0.5 * (ln(2 * pi() * v_{f}) + (f.{f} - m_{f}) ** 2 / v_{f})" for f in _TARGET_FEATURES)} AS logp FROM facts f, c)
SELECT row_id, arg_max(n, logp) AS prediction FROM p GROUP BY row_id""",
    customer_classes=f"""
WITH {ORDER_FACTS}, b AS (SELECT facts.*, o_custkey AS buyer FROM facts JOIN orders ON row_id = o_orderkey),
eps AS (SELECT 1e-9 * greatest({", ".join(f"var_pop({f})" for f in _BUYER_FEATURES)}) AS e, count(*) AS total FROM b),
c AS (SELECT buyer, ln(count(*) / any_value(total)) AS prior,
             {", ".join(f"avg({f}) AS m_{f}, var_pop({f}) + any_value(e) AS v_{f}" for f in _BUYER_FEATURES)} FROM b, eps GROUP BY buyer),
p AS (SELECT row_id, c.buyer, prior - {" - ".join(f"0.5 * (ln(2 * pi() * v_{f}) + (b.{f} - m_{f}) ** 2 / v_{f})" for f in _BUYER_FEATURES)} AS logp
      FROM b, c)
SELECT row_id, CAST(arg_max(buyer, logp) AS BIGINT) AS buyer FROM p GROUP BY row_id""",
    evidence_fits=f"""
WITH RECURSIVE {ORDER_FACTS},
long AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS x, y FROM facts" for f in ORDER_FEATURES)}),
m AS MATERIALIZED (
  SELECT feature, count(*) AS n, var_pop(x) * count(*) AS xx, covar_pop(x, y) * count(*) AS xy, var_pop(y) * count(*) AS yy,
         avg(x) AS mx, avg(y) AS my FROM long GROUP BY feature),
ridge(i, feature, noise, weight, old, coef) AS (
  SELECT 0, feature, n / yy, 1.0::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM m
  UNION ALL
  SELECT i + 1, feature, (n - certain + 2e-6) / (greatest(yy - 2 * c * xy + c * c * xx, 0) + 2e-6), (certain + 2e-6) / (c * c + 2e-6), coef, c
  FROM (SELECT *, xy / (xx + weight / noise) AS c, noise * xx / (weight + noise * xx) AS certain FROM ridge JOIN m USING (feature))
  WHERE i < 300 AND (old IS NULL OR abs(coef - old) >= 1e-3)),
relevance(i, feature, noise, weight, old, coef) AS (
  SELECT 0, feature, n / yy, 1.0::DOUBLE, NULL::DOUBLE, 0.0::DOUBLE FROM m
  UNION ALL
  SELECT i + 1, feature, (n - certain + 2e-6) / (greatest(yy - 2 * c * xy + c * c * xx, 0) + 2e-6), (certain + 2e-6) / (c * c + 2e-6), coef,
         CASE WHEN (certain + 2e-6) / (c * c + 2e-6) < 1e4 THEN c ELSE 0 END
  FROM (SELECT *, noise * xy / (weight + noise * xx) AS c, 1 - weight / (weight + noise * xx) AS certain FROM relevance JOIN m USING (feature))
  WHERE i < 300 AND weight < 1e4 AND (old IS NULL OR abs(coef - old) >= 1e-3)),
fits AS (
  SELECT 'bayesridge' AS learner, feature, xy / (xx + arg_max(weight, i) / arg_max(noise, i)) AS slope FROM ridge JOIN m USING (feature) GROUP BY feature, xx, xy
  UNION ALL SELECT 'ardr', feature, arg_max(coef, i) FROM relevance GROUP BY feature)
SELECT learner, feature, round(my - mx * slope, 5) + 0.0 AS intercept, round(slope, 5) + 0.0 AS slope FROM fits JOIN m USING (feature)""",
    wide_fold_scores=f"""
WITH b AS (SELECT l_orderkey % {_FOLDS} AS fold, dayofyear(l_shipdate) AS day, l_quantity AS y FROM lineitem),
f AS (SELECT k, day, avg(y) AS p FROM b, range(0, {_FOLDS}) t(k) WHERE fold <> k GROUP BY k, day)
SELECT b.fold, count(*) AS rows, round(avg(abs(y - coalesce(f.p, first.p))), 5) AS mae
FROM b LEFT JOIN f ON f.k = b.fold AND f.day = b.day LEFT JOIN f AS first ON first.k = b.fold AND first.day = 1 GROUP BY b.fold""",
    wide_fold_fits=f"""
WITH b AS (SELECT l_orderkey % {_FOLDS} AS fold, dayofyear(l_shipdate) AS day, l_quantity AS y FROM lineitem)
SELECT k AS fold, day, round(avg(y), 5) AS prediction FROM b, range(0, {_FOLDS}) t(k) WHERE fold <> k GROUP BY k, day""",
    least_squares_fit=f"""
WITH {ORDER_FACTS}, fit AS (SELECT regr_slope(y, price) AS s, regr_intercept(y, price) AS i FROM facts)
SELECT round(avg(abs(y - (i + s * price))), 6) AS mae, round(any_value(i), 6) AS intercept, round(any_value(s), 6) AS slope
FROM facts, fit""",
)

_LONG_SINGLE = " UNION ALL ".join(f"SELECT '{g}' AS genome, fold, {f} AS x, y FROM b" for g, f in zip(_SINGLE, ORDER_FEATURES))
_BAND_GENOMES = ["".join("1" if i == j else "0" for j in range(len(_BANDS))) for i in range(len(_BANDS))]
# Boosted stumps on one feature in few bands. A row for each fit and band holds the rows and the sum of
# the target it is grown on, and the running margin.
_STUMPS = f"""
long AS MATERIALIZED ({" UNION ALL ".join(f"SELECT '{g}' AS genome, fold, {e}::DOUBLE AS x, y FROM b" for g, e in zip(_BAND_GENOMES, _BANDS.values()))}),
cells AS MATERIALIZED (
  SELECT genome, k, x, count(*) FILTER (WHERE fold <> k) AS n, coalesce(sum(y) FILTER (WHERE fold <> k), 0) AS s
  FROM long, range(0, {_FOLDS}) t(k) GROUP BY genome, k, x),
grown(r, genome, k, x, n, s, f) AS (
  SELECT 0, genome, k, x, n, s, sum(s) OVER (PARTITION BY genome, k) / sum(n) OVER (PARTITION BY genome, k) FROM cells
  UNION ALL
  SELECT r + 1, genome, k, x, n, s, f + 0.1::DOUBLE * CASE WHEN x <= cut THEN low / nlow ELSE (g - low) / (nn - nlow) END
  FROM (
    SELECT *, first_value(x) OVER best AS cut, first_value(gl) OVER best AS low, first_value(nl) OVER best AS nlow
    FROM (
      SELECT *, CASE WHEN nl > 0 AND nn > nl THEN gl * gl / nl + (g - gl) * (g - gl) / (nn - nl) END AS gain
      FROM (
        SELECT *, sum(s - n * f) OVER upto AS gl, sum(n) OVER upto AS nl, sum(s - n * f) OVER whole AS g, sum(n) OVER whole AS nn
        FROM grown WHERE r < {_STUMP_TREES}
        WINDOW upto AS (PARTITION BY genome, k ORDER BY x), whole AS (PARTITION BY genome, k)))
    WINDOW best AS (PARTITION BY genome, k ORDER BY gain DESC NULLS LAST, x))),
stump_errors AS (
  SELECT l.genome, l.fold, avg(abs(y - greatest(0, f))) AS e
  FROM long l JOIN grown g ON r = {_STUMP_TREES} AND l.genome = g.genome AND l.fold = g.k AND l.x = g.x GROUP BY l.genome, l.fold),
stump_scores AS MATERIALIZED (SELECT genome, -avg(e) - 0.00001::DOUBLE AS score FROM stump_errors GROUP BY genome)"""


def _sql_stump_search(per_run: int, count: int) -> str:
    """Searches over the banded features; masks of none or several are refused."""
    size = len(_BANDS)
    total, some = sql_int("1001", "run_id", "idx", "'total'"), sql_int(str(size + 1), "run_id", "idx", "'baseline'")
    steps, last = mask_sql.search("start", size, count)
    parts = [
        _FOLDED, _STUMPS, mask_sql.every_mask(size),
        f"mask_scores AS MATERIALIZED (SELECT genome, coalesce(score, {mask_sql.REFUSED}) AS score FROM masks LEFT JOIN stump_scores USING (genome))",
        f"runs AS (SELECT s_suppkey // {per_run} AS run_id, count(*) AS n FROM supplier GROUP BY 1)",
        f"people AS (SELECT run_id, idx, n, least({some}, {total}) AS wanted FROM runs, range(0, {per_run}) t(idx) WHERE idx < n)",
        f"""places AS (SELECT run_id, idx, n, wanted, i, row_number() OVER (PARTITION BY run_id, idx ORDER BY
              {sql_draw("run_id", "idx", "'b'", "i")}, i) AS place FROM people, range(0, {size}) t(i))""",
        """start AS (SELECT run_id, idx, any_value(n) AS n, 0.22 AS pc, 0.1 AS pm,
              string_agg(CASE WHEN place <= wanted THEN '1' ELSE '0' END, '' ORDER BY i) AS genome FROM places GROUP BY run_id, idx)""",
        *steps,
    ]
    return f"WITH RECURSIVE {', '.join(parts)} SELECT run_id, idx, genome, round(score, 6) AS score FROM {last}"


ORACLE.update(
    stump_mask_scores=f"WITH RECURSIVE {_FOLDED}, {_STUMPS} SELECT genome, round(score, 6) AS score FROM stump_scores",
    drawn_stump_scores=f"""
WITH {ORDER_FACTS}, b AS MATERIALIZED ({sql_folds("facts", "row_id", _FOLDS)}),
long AS MATERIALIZED ({" UNION ALL ".join(
    f"SELECT '{g}' AS genome, {i} AS feature, fold, {f} AS x, y FROM b" for i, (g, f) in enumerate(zip(_SINGLE, ORDER_FEATURES)))}),
ends AS (SELECT genome, feature, k, min(x) AS low, max(x) AS high FROM long, range(0, {_FOLDS}) t(k) WHERE fold <> k GROUP BY ALL),
cuts AS MATERIALIZED (SELECT genome, k, tree, low + {sql_draw("tree", "0", "feature")} * (high - low) AS cut FROM ends, range(0, {_DRAWN_TREES}) t(tree)),
leaves AS MATERIALIZED (
  SELECT c.genome, c.k, tree, cut, avg(y) FILTER (WHERE x <= cut) AS low, avg(y) FILTER (WHERE x > cut) AS high
  FROM cuts c JOIN long l ON l.genome = c.genome AND l.fold <> c.k GROUP BY ALL),
told AS (
  SELECT l.genome, l.fold, avg(CASE WHEN x <= cut THEN low ELSE high END) AS p, any_value(y) AS y
  FROM (SELECT *, row_number() OVER () AS at FROM long) l JOIN leaves v ON l.genome = v.genome AND l.fold = v.k GROUP BY l.genome, l.fold, l.at),
errors AS (SELECT genome, fold, avg(abs(y - greatest(0, p))) AS e FROM told GROUP BY genome, fold)
SELECT genome, round(-avg(e) - 0.00001, 6) AS score FROM errors GROUP BY genome""",
    stump_search=_sql_stump_search(50, _SEARCH_ITERATIONS + 1),
    stump_curve=f"""
WITH RECURSIVE {ORDER_CLASSES}, b AS MATERIALIZED ({sql_folds("classes", "row_id", _FOLDS)}),
cells AS MATERIALIZED (
  SELECT k, n AS x, count(*) FILTER (WHERE fold <> k) AS rows, count(*) FILTER (WHERE fold <> k AND label = 1) AS ones,
    count(*) FILTER (WHERE fold = k AND label = 1) AS pos, count(*) FILTER (WHERE fold = k AND label = 0) AS neg
  FROM b, range(0, {_FOLDS}) t(k) GROUP BY k, n),
grown(r, k, x, rows, ones, pos, neg, f) AS (
  SELECT 0, k, x, rows, ones, pos, neg,
    ln(sum(ones) OVER (PARTITION BY k) / (sum(rows) OVER (PARTITION BY k) - sum(ones) OVER (PARTITION BY k))) FROM cells
  UNION ALL
  SELECT r + 1, k, x, rows, ones, pos, neg, f + 0.3::DOUBLE * CASE WHEN x <= cut THEN low / hlow ELSE (g - low) / (h - hlow) END
  FROM (
    SELECT *, first_value(x) OVER best AS cut, first_value(gl) OVER best AS low, first_value(hl) OVER best AS hlow
    FROM (
      SELECT *, CASE WHEN nl > 0 AND nn > nl THEN gl * gl / hl + (g - gl) * (g - gl) / (h - hl) END AS gain
      FROM (
        SELECT *, sum(ones - rows * p) OVER upto AS gl, sum(rows * p * (1 - p)) OVER upto AS hl, sum(rows) OVER upto AS nl,
          sum(ones - rows * p) OVER whole AS g, sum(rows * p * (1 - p)) OVER whole AS h, sum(rows) OVER whole AS nn
        FROM (SELECT *, 1 / (1 + exp(-f)) AS p FROM grown WHERE r < 200)
        WINDOW upto AS (PARTITION BY k ORDER BY x), whole AS (PARTITION BY k)))
    WINDOW best AS (PARTITION BY k ORDER BY gain DESC NULLS LAST, x))),
steps AS (SELECT r, k, floor(4096 / (1 + exp(-f))) AS step, sum(pos) AS pos, sum(neg) AS neg FROM grown WHERE r > 0 GROUP BY ALL),
below AS (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY r, k ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS less FROM steps),
per_fold AS (SELECT r, k, sum(pos * (less + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM below GROUP BY r, k),
curve AS (SELECT r, avg(auc) AS auc, count(*) AS folds FROM per_fold GROUP BY r),
gains AS (
  SELECT *, auc > coalesce(max(auc) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) + 1e-12::DOUBLE AS better FROM curve),
since AS (SELECT *, r - max(CASE WHEN better THEN r END) OVER (ORDER BY r) AS still FROM gains)
SELECT r::INT AS round, round(auc, 6) AS auc, folds FROM since WHERE r <= coalesce((SELECT min(r) FROM since WHERE still >= 50), 200)""",
    elastic_mask_scores=f"""
WITH {ORDER_FACTS}, b AS ({sql_folds("facts", "row_id", _FOLDS)}), long AS ({_LONG_SINGLE}),
m AS (SELECT genome, k, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS c, var_pop(x) AS v FROM long, range(0, {_FOLDS}) t(k) WHERE fold <> k GROUP BY genome, k),
fits AS (SELECT genome, k, mx, my, sign(c) * greatest(abs(c) - 0.5, 0) / (v + 0.5) AS w FROM m),
errors AS (SELECT l.genome, k, avg(abs(y - greatest(0, my + w * (x - mx)))) AS e
           FROM long l JOIN fits f ON l.genome = f.genome AND l.fold = f.k GROUP BY l.genome, k)
SELECT genome, round(-avg(e) - 0.00001, 6) AS score FROM errors GROUP BY genome""",
)
