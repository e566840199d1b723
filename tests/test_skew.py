"""A third of all rows shares one key."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from featurelab.operators import clean, folds, metrics, profile, temporal
from featurelab.operators.ranks import exact_quantiles, range_bucket

ROWS = 6000


@pytest.fixture(scope="module")
def hot(spark):
    rng = np.random.default_rng(9)
    ids = np.arange(ROWS)
    key = np.where(ids % 3 == 0, 0, rng.integers(1, 400, ROWS))
    pdf = pd.DataFrame(
        {
            "id": ids,
            "key": key,
            "name": [f"k{k}" for k in key],
            "day": [dt.date(2021, 1, 1) + dt.timedelta(days=int(d)) for d in rng.integers(0, 60, ROWS)],
            "x": np.where(ids % 3 == 0, 2.5, rng.normal(size=ROWS).round(2)),
            "label": (rng.random(ROWS) < 0.3).astype(int),
        }
    )
    return pdf, spark.createDataFrame(pdf).repartition(6).cache()


def test_series_of_a_hot_group(hot):
    pdf, df = hot
    got = temporal.window_features(df, "day", ["x"], ["key"], [1], [3], ("rolling",)).toPandas()
    daily = pdf.groupby(["key", "day"], as_index=False)["x"].sum().sort_values(["key", "day"])
    daily["want"] = daily.groupby("key")["x"].transform(lambda s: s.rolling(3).mean().shift(1))
    both = got.merge(daily, on=["key", "day"])
    assert len(both) == len(got) == len(daily)
    np.testing.assert_allclose(both[temporal.feature_name("x", "rolling", 1, 3)].astype(float), both["want"], atol=1e-12)


def test_join_keeps_every_hot_row(hot):
    pdf, df = hot
    means = df.groupBy("key").agg(F.avg("x").alias("m"))
    joined = clean.aligned_join(df, means, ["key"])
    assert joined.count() == ROWS
    assert clean.members(df, means.filter("key = 0"), ["key"]).count() == (pdf["key"] == 0).sum()


def test_quantiles_of_a_hot_value(hot):
    pdf, df = hot
    probs = [0.05, 0.5, 0.75, 0.9, 0.95]
    found = exact_quantiles(df, ["x"], probs, finish_distinct=10, accuracy=40)
    for p in probs:
        assert found["x", p] == pytest.approx(np.quantile(pdf["x"], p))


def test_auc_of_a_hot_score(hot):
    pdf, df = hot
    ranks = pdf["x"].rank()
    pos = pdf["label"] == 1
    want = (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert metrics.roc_auc(df, "label", "x", buckets=16).first()["auc"] == pytest.approx(want)


def test_auc_when_nearly_all_scores_are_equal(spark, monkeypatch):
    df = spark.range(200_000).select(
        F.when(F.col("id") % 2000 == 0, F.col("id")).otherwise(0).cast("double").alias("x"),
        (F.col("id") % 3 == 0).cast("int").alias("label"),
    )
    held = []

    def watched(cells, column, out, buckets):
        ranged = range_bucket(cells, column, out, buckets)
        held.extend(r["count"] for r in ranged.groupBy(out).count().collect())
        return ranged

    monkeypatch.setattr(metrics, "range_bucket", watched)
    got = metrics.roc_auc(df, "label", "x", buckets=10).first()["auc"]
    pdf = df.toPandas()
    ranks, pos = pdf["x"].rank(), pdf["label"] == 1
    want = (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (float(pos.sum()) * (~pos).sum())
    assert got == pytest.approx(want)
    assert sum(held) == 100 and max(held) <= 20


def test_copies_of_a_hot_row(hot):
    pdf, df = hot
    folded = folds.random_folds(df, "id", 4)
    fold = folded.select("id", "fold").toPandas().set_index("id")["fold"]
    pdf = pdf.assign(fold=fold.reindex(pdf["id"]).to_numpy())
    for r in folds.fold_copies(folded, ["name", "x"], 4).collect():
        here, other = pdf[pdf["fold"] == r["fold"]], pdf[pdf["fold"] != r["fold"]]
        assert r["inside_fold"] == here.duplicated(["name", "x"]).sum()
        assert r["other_folds"] == other.duplicated(["name", "x"]).sum()
        assert r["all_folds"] == pdf.duplicated(["name", "x"]).sum()


def test_rare_categories_beside_a_hot_one(hot):
    pdf, df = hot
    folded = profile.fold_rare(df.select("id", "name"), "name", 0.1)
    counts = {r["name"]: r["count"] for r in folded.groupBy("name").count().collect()}
    assert counts == {"k0": ROWS}
    report = {r["value"]: r["length"] for r in profile.rare_categories(df.select("name")).collect()}
    assert report == pdf["name"].value_counts().to_dict()
