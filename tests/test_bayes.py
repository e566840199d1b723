"""Naive Bayes against plain loops, with few and with very many classes."""

import time

import numpy as np
import pandas as pd
import pytest

from featurelab.models import bayes

NAMES = ["a", "b.c", "d"]


def table(rows, classes, seed=3):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, classes, rows)
    x = rng.poisson(3 + (label[:, None] * [1, 2, 3]) % 7, (rows, 3)) + rng.random((rows, 3))
    return pd.DataFrame(x, columns=NAMES).assign(label=label.astype(float), row=np.arange(rows))


def by_loops(pdf, kind, smoothing=1.0):
    x, y = pdf[NAMES].to_numpy(), pdf["label"].to_numpy()
    extra = 1e-9 * x.var(axis=0).max()
    found = np.empty((len(x), len(np.unique(y))))
    for i, c in enumerate(np.unique(y)):
        here = x[y == c]
        if kind == "multinomial":
            shares = (here.sum(axis=0) + smoothing) / (here.sum() + smoothing * 3)
            found[:, i] = np.log(len(here) / len(x)) + x @ np.log(shares)
        else:
            v = here.var(axis=0) + extra
            found[:, i] = np.log(len(here) / len(x)) - 0.5 * (np.log(2 * np.pi * v) + (x - here.mean(axis=0)) ** 2 / v).sum(axis=1)
    return np.unique(y)[found.argmax(axis=1)]


@pytest.mark.parametrize("kind", ["multinomial", "gaussian"])
def test_classes_match_plain_loops(spark, kind):
    pdf = table(400, 12)
    df = spark.createDataFrame(pdf)
    fitted = bayes.class_table(df, NAMES, "label", kind)
    want = dict(enumerate(by_loops(pdf, kind)))
    for page_bytes in (bayes.PAGE_BYTES, 8 * 8 * 4):  # one page, then about three
        got = bayes.predict_class(df, fitted, NAMES, page_bytes=page_bytes)
        assert got.columns == [*df.columns, "prediction"]
        assert {r["row"]: r["prediction"] for r in got.collect()} == want


def test_many_classes_take_seconds(spark):
    pdf = table(2000, 1500)
    df = spark.createDataFrame(pdf)
    started = time.time()
    fitted = bayes.class_table(df, NAMES, "label", "gaussian")
    got = {r["row"]: r["prediction"] for r in bayes.predict_class(df, fitted, NAMES).collect()}
    assert time.time() - started < 30
    assert got == dict(enumerate(by_loops(pdf, "gaussian")))


def test_a_class_for_every_row(spark):
    """100,000 classes of one row each: every row of a sample finds itself."""
    df = spark.range(100_000).selectExpr("id * 1.0D AS label", "id * 1.0D AS a", "(id * 7919) % 100000 * 1.0D AS d")
    fitted = bayes.class_table(df, ["a", "d"], "label", "gaussian")
    assert fitted.classes == 100_000
    some = bayes.predict_class(df.where("label % 1000 = 0"), fitted, ["a", "d"])
    assert some.where("prediction = label").count() == some.count() == 100


def test_ties_nulls_and_clashing_names(spark):
    rows = [(1.0, 1.0, 2.0), (2.0, 1.0, 2.0), (None, 5.0, 5.0), (3.0, None, 1.0), (3.0, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "label double, a double, _best_class double")
    names = ["a", "_best_class"]
    fitted = bayes.class_table(df, names, "label", "multinomial")
    assert fitted.classes == 2  # only complete rows are learned from
    got = [r["prediction"] for r in bayes.predict_class(df, fitted, names).collect()]
    assert got == [1.0, 1.0, 1.0, None, None]  # equal classes: the smaller one
    assert bayes.predict_class(df.limit(0), fitted, names).count() == 0
    with pytest.raises(ValueError, match="0 or more"):
        bayes.class_table(spark.createDataFrame([(1.0, -1.0)], "label double, a double"), ["a"], "label", "multinomial")
    with pytest.raises(ValueError, match="no complete row"):
        bayes.class_table(df.limit(0), names, "label", "gaussian")


def test_leaves_spare_most_classes(monkeypatch):
    """Rows meet a small part of the classes and get the same class and score as from all of them."""
    rng = np.random.default_rng(8)
    size = 20_000
    told = np.column_stack([rng.normal(0, 0.5, (size, 2)), rng.gamma(2.0, 0.5, (size, 2)) + 1e-6])
    told[-500:] = told[:500]  # equal classes: the smaller one
    page = np.arange(size) * 2.0, np.log(rng.integers(1, 30, size) / 3e5), told
    x = rng.normal(0, 1.2, (2_000, 2))
    x[7, 0] = np.inf
    met, plain = [], bayes._log_likelihood
    monkeypatch.setattr(bayes, "_log_likelihood", lambda kind, x, prior, told: met.append(len(x) * len(prior)) or plain(kind, x, prior, told))
    found = []
    for one in (page, bayes._leaves(page)):
        met.clear()
        score, best = np.full(len(x), -np.inf), np.full(len(x), np.nan)
        bayes._best_of("gaussian", x, one, score, best)
        found.append((score, best, sum(met)))
    assert np.array_equal(found[0][0], found[1][0], equal_nan=True) and np.array_equal(found[0][1], found[1][1], equal_nan=True)
    assert found[1][2] * 4 < found[0][2]


def test_contenders_are_found_before_rows_meet_classes(spark, monkeypatch):
    """Of many classes few can be the best of any row; the rows get the same classes as from all of them."""
    rng = np.random.default_rng(3)
    size = 3_000
    told = np.column_stack([np.arange(size) * 2.0, np.log(rng.integers(1, 30, size) / 3e4), rng.normal(0, 0.5, (size, 2)), rng.gamma(2.0, 0.5, (size, 2)) + 1e-4])
    told[-50:, 1:] = told[:50, 1:]  # equal classes: the smaller one
    table = spark.createDataFrame([tuple(map(float, r)) for r in told], "class double, prior double, x0 double, x1 double, vx0 double, vx1 double")
    every = bayes.ClassTable(table.repartition(3), "gaussian", 2, size)
    x = [*map(tuple, rng.normal(0, 1.2, (500, 2)).tolist()), (float("inf"), 0.0), (60.0, -80.0), (None, 1.0), (float("nan"), 1.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(x)], "row int, a double, d double").repartition(4)
    monkeypatch.setattr(bayes, "_MANY", size + 1)
    plain = {r["row"]: r["prediction"] for r in bayes.predict_class(df, every, ["a", "d"]).collect()}
    monkeypatch.setattr(bayes, "_MANY", 1)
    left = bayes._contenders(df, every, ["a", "d"])
    assert left.classes * 4 < size and left.table.where("class = 0").count() == 1
    for page_bytes in (bayes.PAGE_BYTES, 4_000):
        got = bayes.predict_class(df, every, ["a", "d"], page_bytes=page_bytes)
        assert {r["row"]: r["prediction"] for r in got.collect()} == plain
    assert bayes.predict_class(df.limit(0), every, ["a", "d"]).count() == 0
