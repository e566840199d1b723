import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from featurelab.models import boosting, gram, layers, learners, masks
from featurelab.operators import folds, metrics

FEATURES = ["a", "b", "c", "d"]


def frame(rows=600, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, 4)) * [1, 3, 0.5, 2] + [0, 100, -1, 5]
    y = 2 * x[:, 0] - 0.3 * x[:, 1] + 0.05 * x[:, 3] + rng.normal(size=rows) + 40
    return pd.DataFrame(x, columns=FEATURES).assign(y=y, row_id=range(rows))


@pytest.fixture(scope="module")
def data(spark):
    return frame(), spark.createDataFrame(frame()).repartition(5).cache()


def lstsq(x, y):
    z = np.column_stack([np.ones(len(x)), x])
    return np.linalg.lstsq(z, y, rcond=None)[0]


def test_least_squares_matches_numpy(data):
    pdf, df = data
    intercept, coef = gram.least_squares(gram.fold_moments(df, FEATURES, "y")[0], [0, 1, 3])
    expected = lstsq(pdf[["a", "b", "d"]].to_numpy(), pdf["y"].to_numpy())
    np.testing.assert_allclose([intercept, *coef], expected, rtol=1e-9)


def test_collinear_features_still_predict(spark):
    pdf = frame().assign(e=lambda f: 2 * f["a"])
    df = spark.createDataFrame(pdf)
    names = [*FEATURES, "e"]
    intercept, coef = gram.least_squares(gram.fold_moments(df, names, "y")[0], list(range(5)))
    got = intercept + pdf[names].to_numpy() @ coef
    z = np.column_stack([np.ones(len(pdf)), pdf[FEATURES]])
    np.testing.assert_allclose(got, z @ lstsq(pdf[FEATURES].to_numpy(), pdf["y"].to_numpy()), atol=1e-7)


@pytest.mark.parametrize("metric", ["mae", "mse", "r2"])
def test_mask_scores_match_numpy(spark, data, metric):
    pdf, df = data
    folded = folds.random_folds(df, "row_id", 3)
    fold = folded.select("row_id", "fold").toPandas().set_index("row_id")["fold"].reindex(pdf["row_id"]).to_numpy()
    scorer = masks.LinearScorer(folded, FEATURES, "y", max_features=3, metric=metric)
    genomes = ["1000", "0101", "1101", "0000", "1111"]
    scorer.score(genomes)
    for g in genomes:
        picked = [f for f, gene in zip(FEATURES, g) if gene == "1"]
        if not 0 < len(picked) <= 3:
            assert scorer.known[g] == -1e36
            continue
        errors = []
        for k in range(3):
            w = lstsq(pdf[fold != k][picked].to_numpy(), pdf[fold != k]["y"].to_numpy())
            p = np.maximum(w[0] + pdf[fold == k][picked].to_numpy() @ w[1:], 0)
            y = pdf[fold == k]["y"].to_numpy()
            errors.append({
                "mae": np.abs(y - p).mean(), "mse": ((y - p) ** 2).mean(),
                "r2": -(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()),
            }[metric])
        assert scorer.known[g] == pytest.approx(-np.mean(errors) - 1e-5 * len(picked), rel=1e-9)


@pytest.mark.parametrize("metric", ["mse", "rmse", "r2"])
def test_squared_errors_need_no_scan(data, metric, monkeypatch):
    pdf, df = data
    folded = folds.random_folds(df, "row_id", 3)
    fold = folded.select("row_id", "fold").toPandas().set_index("row_id")["fold"].reindex(pdf["row_id"]).to_numpy()
    scorer = masks.LinearScorer(folded, FEATURES, "y", metric=metric, clip_negative=False)
    monkeypatch.setattr(scorer, "_scanned", None)
    scorer.score(["0110", "1111"])
    for genome, picked in (("0110", FEATURES[1:3]), ("1111", FEATURES)):
        errors = []
        for k in range(3):
            w = lstsq(pdf[fold != k][picked].to_numpy(), pdf[fold != k]["y"].to_numpy())
            y = pdf[fold == k]["y"].to_numpy()
            away = np.square(y - w[0] - pdf[fold == k][picked].to_numpy() @ w[1:])
            errors.append({
                "mse": away.mean(), "rmse": np.sqrt(away.mean()), "r2": away.sum() / np.square(y - y.mean()).sum() - 1,
            }[metric])
        assert scorer.known[genome] == pytest.approx(-np.mean(errors) - 1e-5 * len(picked), rel=1e-9)


def test_thousands_of_masks_take_one_scan(spark, monkeypatch):
    names = [f"f{i}" for i in range(13)]
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(size=(300, 13)), columns=names).assign(y=rng.normal(size=300) + 3, fold=np.arange(300) % 3)
    scorer = masks.LinearScorer(spark.createDataFrame(pdf), names, "y")
    scans, scanned = [], scorer._scanned
    monkeypatch.setattr(scorer, "_scanned", lambda weights: scans.append(weights.shape) or scanned(weights))
    genomes = [f"{i:013b}" for i in range(1, 5001)]
    scorer.score(genomes)
    assert scans == [(3, 14, 5000)]
    monkeypatch.setattr(masks, "_SCAN_BYTES", 8 * 3 * 15 * 20)  # twenty masks a scan
    again = masks.LinearScorer(spark.createDataFrame(pdf), names, "y")
    again.score(genomes[:50])
    assert {g: scorer.known[g] for g in genomes[:50]} == pytest.approx(again.known)


def test_masks_beyond_a_page_are_scored_too(spark, data):
    _, df = data
    folded = folds.random_folds(df, "row_id", 3)
    people = spark.createDataFrame([("".join(g),) for g in itertools.product("01", repeat=4)] * 2, "genome string")
    whole = masks.LinearScorer(folded, FEATURES, "y")(people)
    paged = masks.LinearScorer(folded, FEATURES, "y", page=6)(people)
    scores = {r["genome"]: r["score"] for r in paged.collect()}
    assert scores == pytest.approx({r["genome"]: r["score"] for r in whole.collect()})
    assert paged.count() == whole.count() == 32


def test_the_memo_is_a_table_with_features(spark, data, monkeypatch):
    _, df = data
    folded = folds.random_folds(df, "row_id", 3)
    monkeypatch.setattr(masks, "_MEMO_PARTS", 3)
    scorer = masks.LinearScorer(folded, FEATURES, "y", max_features=3, exmodel=FEATURES[3:])
    asked, errors = [], scorer._errors
    monkeypatch.setattr(scorer, "_errors", lambda genomes: asked.append(genomes) or errors(genomes))
    assert scorer.solutions().count() == 0
    every = ["".join(g) for g in itertools.product("01", repeat=4)]
    # Populations of growing overlap, joined into one plan: each keeps all its rows.
    parts = [scorer(spark.createDataFrame([(g,) for g in every[:n]], "genome string")) for n in (2, 5, 9, 9, 16)]
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.withColumnRenamed("score", "before").join(part, "genome", "right").drop("before")
    assert joined.count() == 16 and [p.count() for p in parts] == [2, 5, 9, 9, 16]
    assert len(scorer.parts) <= 3
    scored = [g for page in asked for g in page]
    assert sorted(scored) == every[1:-1]  # the empty and the full mask are refused
    rows = {r["genome"]: r for r in scorer.solutions().collect()}
    assert sorted(rows) == every and rows["1111"]["score"] == rows["0000"]["score"] == masks.REFUSED
    one = rows["1011"]
    assert (one["baseline_genes"], one["exmodel_genes"]) == ("101", "1")
    assert one["baseline_features"] == [FEATURES[0], FEATURES[2]] and one["exmodel_features"] == FEATURES[3:]
    with pytest.raises(Exception, match="a mask needs 4 genes"):
        scorer.score(["10"])
    with pytest.raises(ValueError, match="exmodel"):
        masks.LinearScorer(folded, FEATURES, "y", exmodel=["other"])


def test_generic_scorer_agrees_with_the_linear_one(data):
    _, df = data
    folded = folds.random_folds(df, "row_id", 3)
    genomes = ["1100", "0011", "0000"]
    scorer = masks.LinearScorer(folded, FEATURES, "y")
    scorer.score(genomes)
    got = {r["genome"]: r["score"] for r in masks.score_masks(folded, genomes, learners.learner("linear"), FEATURES, "y").collect()}
    assert got == pytest.approx({g: scorer.known[g] for g in genomes})


def test_search_finds_the_informative_features(spark, data):
    _, df = data
    folded = folds.random_folds(df, "row_id", 3)
    scorer = masks.LinearScorer(folded, FEATURES, "y")
    runs = spark.createDataFrame([(0, 8, 0.5, 0.5)], "run_id int, n int, pc double, pm double")
    best = masks.search_masks(runs, scorer, FEATURES, 6).filter("idx = 0").first()
    every = ["".join(g) for g in itertools.product("01", repeat=4)]
    scorer.score(every)
    assert best["score"] == pytest.approx(max(scorer.known.values()), abs=1e-3)
    assert best["genome"].startswith("11")


def test_elastic_net_matches_coordinate_descent(data):
    pdf, df = data
    alpha, ratio = 0.3, 0.5
    x, y = pdf[FEATURES].to_numpy(), pdf["y"].to_numpy()
    xc, yc, n = x - x.mean(0), y - y.mean(), len(y)
    w = np.zeros(4)
    for _ in range(3000):
        for j in range(4):
            rest = yc - xc @ w + xc[:, j] * w[j]
            rho = xc[:, j] @ rest / n
            w[j] = np.sign(rho) * max(abs(rho) - alpha * ratio, 0) / (xc[:, j] @ xc[:, j] / n + alpha * (1 - ratio))
    fitted = learners.learner("elasticnet", alpha=alpha).fit(df, FEATURES, "y")
    np.testing.assert_allclose(list(fitted.model[1].values()), w, atol=1e-6)


def test_bayesian_ridge_maximises_the_evidence(data):
    """Fixed point of the evidence equations, checked on the raw rows."""
    pdf, df = data
    moments = gram.fold_moments(df, FEATURES, "y")[0]
    intercept, coef = gram.bayesian_ridge(moments, [0, 1, 2, 3], tolerance=1e-12)
    x, y = pdf[FEATURES].to_numpy(), pdf["y"].to_numpy()
    xc, yc = x - x.mean(0), y - y.mean()
    noise, weight = 1 / yc.var(), 1.0
    for _ in range(2000):
        cov = np.linalg.inv(weight * np.eye(4) + noise * xc.T @ xc)
        w = noise * cov @ xc.T @ yc
        gamma = 4 - weight * np.trace(cov)
        weight = (gamma + 2e-6) / (w @ w + 2e-6)
        noise = (len(y) - gamma + 2e-6) / (((yc - xc @ w) ** 2).sum() + 2e-6)
    np.testing.assert_allclose(coef, w, rtol=1e-5)
    assert intercept == pytest.approx(y.mean() - x.mean(0) @ coef)


def test_relevance_regression_prunes_noise(data):
    pdf, df = data
    noisy = df.withColumn("junk", F.lit(0.0) + F.sin(F.col("row_id") * 12.9898))
    moments = gram.fold_moments(noisy, [*FEATURES, "junk"], "y")[0]
    _, coef = gram.relevance_regression(moments, [0, 1, 2, 3, 4], prune_above=300)
    expected = lstsq(pdf[FEATURES].to_numpy(), pdf["y"].to_numpy())[1:]
    assert coef[0] == pytest.approx(expected[0], abs=0.05) and coef[4] == 0.0


@pytest.mark.parametrize("name,changes", [
    ("adaboost", dict(rounds=5)), ("extratrees", dict(trees=4, depth=6)), ("lgbm", dict(trees=8, patience=3)),
    ("xgboost", dict(trees=8, depth=3, patience=3)), ("bagging", dict(trees=3, depth=6)),
    ("randomforest", dict(trees=4, depth=6)), ("gradientboosting", dict(trees=8)),
])
def test_tree_learners_beat_the_mean(data, name, changes):
    pdf, df = data
    scored = learners.learner(name, **changes).fit(df, FEATURES, "y").predict(df)
    assert set(scored.columns) == {*df.columns, "prediction"}
    assert metrics.regression_report(scored).first()["mse"] < 0.9 * pdf["y"].var()


def test_catalogue_has_the_live_learners():
    assert len(learners.catalogue()) == 12 and "ardr" not in learners.catalogue()
    assert "ardr" in learners.catalogue({"ardr": {}})


def test_weighted_median(spark):
    values = [F.lit(v) for v in [5.0, 1.0, 3.0]]
    pick = lambda w: spark.range(1).select(learners.weighted_median(values, w)).first()[0]
    assert pick([1.0, 1.0, 1.0]) == 3.0 and pick([9.0, 1.0, 1.0]) == 5.0 and pick([1.0, 9.0, 1.0]) == 1.0


def test_stop_round():
    assert boosting.stop_round([3, 2, 1, 2, 2, 2], 3) == 3
    assert boosting.stop_round([3, 2, 1, 2, 2], 3) is None
    assert boosting.stop_round([3, 2, 2.5, 1.5, 2, 2], 2) == 4


def test_patience_keeps_the_best_round(spark, data):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    _, df = data
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df).select("features", "y")
    train, valid = boosting.hold_out(vectors)
    assert train.count() + valid.count() == 600 and valid.count() > 60
    estimator = GBTRegressor(labelCol="y", maxIter=12, maxDepth=4, stepSize=0.6, seed=3)
    model = boosting.fit_with_patience(estimator, train, valid, 2)
    full = estimator.fit(train)
    errors = full.evaluateEachIteration(valid, "absolute")
    expected = boosting.stop_round(errors, 2) or errors.index(min(errors)) + 1
    assert model.getNumTrees == expected


def test_auc_by_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(int(rng.random() < 0.4), float(rng.integers(0, 20)), int(g)) for g in rng.integers(0, 3, 400)]
    df = spark.createDataFrame(rows, "label int, s double, g int")
    def auc(part):
        pos = [s for l, s, _ in part if l]
        neg = [s for l, s, _ in part if not l]
        return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    for buckets in [2, 5, 1024]:
        assert metrics.roc_auc(df, "label", "s", buckets=buckets).first()["auc"] == pytest.approx(auc(rows))
    for r in metrics.roc_auc(df, "label", "s", ["g"]).collect():
        assert r["auc"] == pytest.approx(auc([x for x in rows if x[2] == r["g"]]))


def test_classifier_report_and_split_counts(spark, data):
    _, df = data
    labelled = folds.random_folds(df.withColumn("label", (F.col("y") > 11).cast("int")), "row_id", 2)
    tuned = boosting.fit_classifier(labelled, FEATURES, "label", GBTClassifier(maxIter=4, maxDepth=2, seed=1), "fold", patience=2)
    row = tuned.report.first()
    assert 1 <= tuned.rounds <= 4 and row["auc"] > 0.8 and row["accuracy"] > 0.7 and row["rows"] == 600
    assert tuned.curve.count() == 4
    counts = {r["feature"]: r["splits"] for r in boosting.split_counts(spark, tuned.model, FEATURES).collect()}
    assert set(counts) == set(FEATURES) and sum(counts.values()) == sum((t.numNodes - 1) // 2 for t in tuned.model.trees)


def test_chromosomes_decode_to_the_grid(spark):
    systems = spark.range(20).withColumnRenamed("id", "system_id")
    for models in [["x"], ["x", "y", "z"]]:
        grid = layers.random_grids(systems, models, 3, 2)
        back = layers.decode_chromosomes(layers.grid_chromosomes(grid, models), models, 3, 2)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, grid.collect()))


def test_layers_use_only_lower_outputs(spark):
    systems = spark.range(5).withColumnRenamed("id", "system_id")
    grid = layers.random_grids(systems, ["x", "y"], 3, 2)
    for r in layers.random_neurons(grid, FEATURES, 3, 2).collect():
        assert all(int(name.split("_N_")[1][0]) < r["layer"] for name in r["exmodel_features"])
        assert len(r["chromosome"]) == len(FEATURES) + 2 * r["layer"]
        assert r["baseline_features"] == [f for f, g in zip(FEATURES, r["baseline_genes"]) if g == "1"]


def test_a_drawn_system_trains(spark, data):
    _, df = data
    systems = spark.range(3).withColumnRenamed("id", "system_id")
    names = ["linear", "bayesridge", "gradientboosting"]
    grid = layers.random_grids(systems, names, 2, 2)
    drawn = layers.random_neurons(grid, FEATURES, 2, 2)
    few = {n: learners.learner(n, **({"trees": 2} if n == "gradientboosting" else {})) for n in names}
    neurons = layers.system_neurons(drawn, 1, few)
    out = layers.train_layers(folds.random_folds(df, "row_id", 2), neurons, 2)
    assert out.columns == ["row_id", "fold", *[n.name for n in neurons]] and len(neurons) == 4
    assert out.count() == 600 and out.na.drop().count() == 600


def test_stacking_is_out_of_fold(spark, data):
    pdf, df = data
    folded = folds.random_folds(df, "row_id", 3)
    neurons = [
        layers.Neuron("n0", 0, learners.learner("linear"), ["a"], []),
        layers.Neuron("n1", 0, learners.learner("bagging", trees=2, depth=3), ["b"], []),
        layers.Neuron("n2", 1, learners.learner("linear"), ["d"], ["n0", "n1"]),
        layers.Neuron("n3", 1, learners.learner("linear"), [], []),
    ]
    out = layers.train_layers(folded, neurons, 3).toPandas().set_index("row_id").loc[pdf["row_id"]]
    fold = out["fold"].to_numpy()
    assert list(out.columns) == ["fold", "n0", "n1", "n2", "n3"]
    for k in range(3):
        train, test = fold != k, fold == k
        w = lstsq(pdf[train][["a"]].to_numpy(), pdf[train]["y"].to_numpy())
        np.testing.assert_allclose(out["n0"][test], w[0] + pdf[test]["a"].to_numpy() * w[1], rtol=1e-9)
        x = np.column_stack([pdf["d"], out["n0"], out["n1"]])
        w = lstsq(x[train], pdf["y"].to_numpy()[train])
        np.testing.assert_allclose(out["n2"][test], w[0] + x[test] @ w[1:], rtol=1e-8)
        np.testing.assert_allclose(out["n3"][test], pdf["y"].to_numpy()[train].mean(), rtol=1e-12)


def test_saved_model_predicts_the_same(spark, data):
    from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor

    from featurelab.operators.encode import feature_vector
    from featurelab.sources.tables import load_model, save_model
    from featurelab.sources.work import new_path

    _, df = data
    vectors = feature_vector(df, FEATURES)
    model = DecisionTreeRegressor(labelCol="y").fit(vectors)
    path = new_path(spark, "tree")
    save_model(model, path)
    again = load_model(DecisionTreeRegressionModel, path)
    assert model.transform(vectors).select("prediction").collect() == again.transform(vectors).select("prediction").collect()
