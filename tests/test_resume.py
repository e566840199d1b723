"""A grid whose training stops goes on from the layers that are finished."""

import numpy as np
import pandas as pd
import pytest

from featurelab.models import layers, learners
from featurelab.operators import folds

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def facts(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(240, 3))
    pdf = pd.DataFrame(x, columns=FEATURES).assign(row_id=np.arange(240), y=x @ [2.0, -1.0, 0.5] + rng.normal(size=240))
    return folds.random_folds(spark.createDataFrame(pdf), "row_id", 2)


def drawn_grid(spark, ridge):
    """The 4 x 4 grid of one drawn system."""
    systems = spark.range(1).withColumnRenamed("id", "system_id")
    names = ["linear", "ridge", "elasticnet"]
    grid = layers.random_neurons(layers.random_grids(systems, names, 4, 4), FEATURES, 4, 4)
    told = {"linear": learners.learner("linear"), "ridge": ridge, "elasticnet": learners.learner("elasticnet", alpha=0.1)}
    return layers.system_neurons(grid, 0, told)


def test_training_goes_on_after_a_stop(spark, facts, tmp_path, monkeypatch):
    neurons = drawn_grid(spark, learners.learner("bayesridge"))
    assert len(neurons) == 16
    whole = {r["row_id"]: r for r in layers.train_layers(facts, neurons, 2).collect()}

    trained, fit = [], layers._fold_value

    def stops(table, here, k):
        if here[0].layer == 2 and len(trained) == 2:
            raise RuntimeError("lost")
        trained.append(here[0].layer)
        return fit(table, here, k)

    manifest = str(tmp_path / "manifest")
    with monkeypatch.context() as patched:
        patched.setattr(layers, "_fold_value", stops)
        with pytest.raises(RuntimeError, match="lost"):
            layers.train_layers(facts, neurons, 2, manifest=manifest)
    assert trained == [0, 1]

    after = []
    monkeypatch.setattr(layers, "_fold_value", lambda t, here, k: after.append(here[0].layer) or fit(t, here, k))
    again = {r["row_id"]: r for r in layers.train_layers(facts, drawn_grid(spark, learners.learner("bayesridge")), 2, manifest=manifest).collect()}
    assert after == [2, 3]
    assert sorted(again) == sorted(whole)
    np.testing.assert_allclose([again[k] for k in sorted(again)], [whole[k] for k in sorted(whole)], rtol=1e-9)
    assert layers.Manifest(spark, manifest).entries().count() == 4

    # All is done; then other settings, other rows, another clipping train anew.
    after.clear()
    layers.train_layers(facts, neurons, 2, manifest=manifest)
    assert after == []
    layers.train_layers(facts.where("row_id > 0"), neurons[:4], 2, manifest=manifest)
    layers.train_layers(facts, neurons[:4], 2, clip_negative=True, manifest=manifest)
    assert after == [0, 0]


def test_settings_are_told_apart():
    told = [
        layers._told(learners.learner(n, **c).fit)
        for n, c in [
            ("elasticnet", {}), ("elasticnet", {"alpha": 0.5}), ("adaboost", {}), ("adaboost", {"rounds": 3}), ("bagging", {}),
            ("randomforest", {}), ("lgbm", {}), ("lgbm", {"trees": 5}), ("multinomial", {}), ("gaussiannb", {}), ("extratrees", {}),
        ]
    ]
    assert len(set(told)) == len(told) and not any("0x" in t for t in told)
    assert told[0] == layers._told(learners.learner("elasticnet").fit)
