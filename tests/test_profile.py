import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from featurelab.functions.names import SIGNS, clean_name
from featurelab.operators import metrics, profile, ranks
from featurelab.operators.ranks import exact_quantiles, ordered_position


def test_clean_name_is_literal_and_ordered():
    assert clean_name("a.b (c)") == "a_b_c_"
    assert clean_name("x___y") == "x__y"
    assert len(SIGNS) == 15


@pytest.mark.parametrize("finish", [5, 1_000_000])
def test_exact_quantiles_with_and_without_narrowing(spark, finish):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=4000), np.full(2500, 0.25), rng.lognormal(3, 3, 1000)])
    df = spark.createDataFrame(pd.DataFrame({"x": values, "y": np.round(values, 1)})).repartition(7)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    found = exact_quantiles(df, ["x", "y"], probs, finish_distinct=finish, accuracy=50)
    for c, data in [("x", values), ("y", np.round(values, 1))]:
        for p in probs:
            assert found[c, p] == pytest.approx(np.quantile(data, p), rel=1e-12)


def test_quantiles_where_no_sketch_helps(spark, monkeypatch):
    rng = np.random.default_rng(3)
    spread = rng.normal(size=3000) * 10.0 ** rng.integers(-200, 200, 3000)
    values = np.concatenate([spread, np.repeat([0.0, -0.0, 7.5, 1e-320, -1e-320], 200), [np.inf, -np.inf]])
    two = np.repeat([-1e300, 1e300], len(values) // 2)
    df = spark.createDataFrame(pd.DataFrame({"x": values, "two": two})).repartition(5)
    whole, probs = ranks._narrow, [0.0, 0.013, 0.25, 0.4999, 0.5, 0.77, 0.999, 1.0]
    monkeypatch.setattr(ranks, "_narrow", lambda data, bands, accuracy: bands)  # every bracket stays open
    found = exact_quantiles(df, ["x", "two"], probs, finish_distinct=3)
    monkeypatch.setattr(ranks, "_narrow", whole)
    plain = exact_quantiles(df, ["x", "two"], probs)
    for p in probs:
        assert found["x", p] == plain["x", p] and found["two", p] == plain["two", p]
        assert found["x", p] == pytest.approx(_plain_quantile(values, p), rel=1e-12, abs=0)
        assert found["two", p] == _plain_quantile(two, p)


def _plain_quantile(values, p):
    ordered, place = np.sort(values), (len(values) - 1) * p
    low, high = ordered[int(place)], ordered[min(int(place) + 1, len(values) - 1)]
    return low if low == high or place == int(place) else low + (high - low) * (place - int(place))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5]) == {("x", 0.5): None}


def test_ordered_position_counts_every_row_once(spark):
    df = spark.range(5000).withColumn("k", (F.col("id") % 13).cast("double"))
    placed = ordered_position(df, "k", [F.col("k"), F.col("id").desc()], "place", buckets=4)
    rows = sorted(placed.collect(), key=lambda r: r["place"])
    assert [r["place"] for r in rows] == list(range(5000))
    assert rows == sorted(rows, key=lambda r: (r["k"], -r["id"]))


def test_describe_matches_pandas(spark):
    data = pd.DataFrame({"a": [1.0, 2.0, 2.0, 9.0], "b": [5, 5, 5, 5]})
    rows = {r["column"]: r for r in profile.describe_numeric(spark.createDataFrame(data)).collect()}
    for c in data:
        d = data[c].describe()
        got = [rows[c][k] for k in ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]]
        assert got == pytest.approx(list(d))


def test_constant_columns(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [r["x"] for r in profile.z_score(df, ["x"]).collect()] == [None, None]
    assert [r["x"] for r in profile.min_max(df, ["x"]).collect()] == [0.0, 0.0]


def test_top_category_tie_and_empty_string(spark):
    df = spark.createDataFrame([("b",), ("b",), ("a",), ("a",), ("",), (None,)], "c string")
    row = profile.describe_strings(df).first()
    assert (row["count"], row["unique"], row["top"]) == (5, 3, "a")


def test_likes_with_zero_mad(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 1.0), (3, 7.0), (4, -2.0)], "i int, x double")
    rows = {r["i"]: r for r in profile.label_likes(df, "x", 3.0).collect()}
    assert rows[4]["x"] == 0.0
    assert [rows[i]["like"] for i in range(5)] == [0, 0, 0, 2, 0]


def likes_in_pandas(x, threshold):
    x = np.where(x < 0, 0, x)
    med = np.median(x)
    mad = np.median(np.abs(x - med))
    bad = np.abs(x - med) / mad > threshold
    good = x[~bad]
    scaled = (x - good.min()) / (good.max() - good.min())
    mean = ((good - good.min()) / (good.max() - good.min())).mean()
    return np.where(bad, np.where(x > good.min(), 2, 0), np.where(scaled > mean, 1, 0))


def test_likes_match_numpy(spark):
    x = np.random.default_rng(1).normal(5, 4, 500).round(2)
    df = spark.createDataFrame(pd.DataFrame({"i": range(500), "x": x}))
    rows = profile.label_likes(df, "x", 2.0).orderBy("i").collect()
    assert [r["like"] for r in rows] == list(likes_in_pandas(x, 2.0))


@pytest.mark.parametrize("max_broadcast", [0, 1000])
def test_fold_rare_with_and_without_broadcast(spark, max_broadcast):
    values = ["a"] * 60 + ["b"] * 30 + ["c"] * 9 + ["d"] + [None] * 5
    df = spark.createDataFrame([(v,) for v in values], "c string")
    counts = {r["c"]: r["count"] for r in profile.fold_rare(df, "c", 0.2, max_broadcast).groupBy("c").count().collect()}
    assert counts == {"a": 70, "b": 30, None: 5}


def test_outliers_are_upper_tail_only(spark):
    df = spark.createDataFrame([(float(v),) for v in [-100, 0, 0, 0, 0, 0, 0, 100]], "x double")
    counts = {r["k"]: r["count"] for r in profile.outlier_counts(df).collect()}
    assert counts == {1.0: 1, 2.0: 0, 2.5: 0, 3.0: 0} or counts[1.0] == 1


def test_profile_object(spark):
    df = spark.createDataFrame([(1.0, "x y"), (2.0, "z")], "`a b` double, c string")
    p = profile.Profile(df).with_clean_values()
    assert p.data.columns == ["a_b", "c"]
    assert {r["c"] for r in p.data.collect()} == {"x_y", "z"}
    assert p.numeric().count() == 1 and p.strings().count() == 1
    assert p.outliers().count() == 4 and p.categories().count() == 2
    assert {r["c"] for r in p.with_rare_folded("c", 0.6).data.collect()} == {"x_y"}


def test_decimal_and_whole_columns(spark):
    df = spark.sql("SELECT cast(v AS decimal(10, 2)) AS d, cast(v AS int) AS i, v AS x FROM VALUES (1.5D), (2.5D), (9.0D), (-3.0D) t(v)")
    rows = {r["column"]: r for r in profile.describe_numeric(df).collect()}
    assert rows["d"]["mean"] == rows["x"]["mean"] == 2.5 and rows["i"]["q50"] == 1.5
    assert profile.outlier_counts(df).count() == 12
    assert [r["d"] for r in profile.z_score(df, ["d"]).collect()] == pytest.approx([r["x"] for r in profile.z_score(df, ["x"]).collect()])
    assert profile.min_max(df, ["d", "i"]).count() == 4 and profile.label_likes(df, "d", 1.0).count() == 4
    assert profile.group_sum(df, ["i"]).count() == 4


def test_nan_counts_as_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", float("nan"))], "k string, x double")
    row = profile.describe_numeric(df, ["x"]).first()
    assert (row["count"], row["mean"], row["max"]) == (2, 1.5, 2.0)
    assert profile.group_sum(df, ["k"]).first()["x"] == 3.0
    assert [r["x"] for r in profile.min_max(df, ["x"]).select("x").collect()] == [0.0, 1.0, None]


def test_text_column_without_values_is_described(spark):
    df = spark.createDataFrame([("b", None), ("a", None)], "t string, n string")
    got = {r["column"]: tuple(r)[1:] for r in profile.describe_strings(df).collect()}
    assert got == {"t": (2, 2, "a", 1), "n": (0, 0, None, None)}


def test_nan_and_dotted_names(spark):
    nan = float("nan")
    df = spark.createDataFrame([("k", 1.0, 4.0), ("k", 2.0, nan), ("l", nan, 6.0), ("l", 9.0, None)], "`g.h` string, `a.b` double, c double")
    numbers = ["a.b", "c"]
    assert profile.medians_and_mads(df, numbers) == {"a.b": (2.0, 1.0), "c": (5.0, 1.0)}
    assert profile.medians_and_mads(df.where("c is null"), ["c"]) == {"c": (None, None)}
    told = {r["column"]: r for r in profile.describe_numeric(df).collect()}
    assert told["a.b"]["count"] == 3 and told["a.b"]["q50"] == 2.0 and told["c"]["mean"] == 5.0
    assert {r["g.h"]: r["a.b"] for r in profile.group_sum(df, ["g.h"]).collect()} == {"k": 3.0, "l": 9.0}
    assert profile.outlier_counts(df, numbers, [0.0]).where("column = 'a.b'").first()["count"] == 1
    assert [r["a.b"] for r in profile.min_max(df, numbers).collect()] == [0.0, 0.125, None, 1.0]
    assert profile.z_score(df, numbers).where("`a.b` is null").count() == 1
    rows = [(1.0,), (2.0,), (2.5,), (nan,), (500.0,), (None,)]
    labelled = profile.label_likes(spark.createDataFrame(rows, "`x.y` double"), "x.y", 3.0).collect()
    assert [r["like"] for r in labelled] == [0, 1, 1, 0, 2, 0]
    report = metrics.regression_report(spark.createDataFrame([(1.0, 2.0), (nan, 1.0), (3.0, nan), (5.0, 5.0)], "y double, prediction double")).first()
    assert (report["rows"], report["mae"], report["mse"]) == (4, 0.5, 0.5)
