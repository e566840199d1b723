import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from featurelab.functions.draws import hash32
from featurelab.operators import clean, encode, folds, temporal
from featurelab.operators.ranks import hash_cuts
from featurelab.sources import tables
from featurelab.sources.work import checkpoint_dir, new_path


def test_checkpoint_dir_is_the_named_one(spark):
    assert spark.conf.get("spark.checkpoint.dir") in checkpoint_dir(spark)


def test_csv_round_trip(spark):
    df = spark.createDataFrame([(1, 'a,"b" c', 2.5, None)], "i int, s string, x double, n int")
    path = new_path(spark, "csv")
    tables.write_csv(df, path)
    assert tables.read_csv(spark, path, df.schema).collect() == df.collect()
    assert dict(tables.read_csv(spark, path).dtypes)["x"] == "double"


def test_csv_written_elsewhere(spark, tmp_path):
    pd.DataFrame({"i": [1, 2], "s": ['say "hi", you', "two\nlines"], "d": ["2020-01-31", None]}).to_csv(
        tmp_path / "t.csv", index=False
    )
    rows = tables.read_csv(spark, str(tmp_path / "t.csv"), "i int, s string, d string", multiLine=True).collect()
    assert [tuple(r) for r in rows] == [(1, 'say "hi", you', "2020-01-31"), (2, "two\nlines", None)]


def test_clamp_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (2.0,)], "x double")
    assert [r[0] for r in df.select(clean.clamp_negative(F.col("x"))).collect()] == [None, 0.0, 2.0]


@pytest.mark.parametrize("rows,k", [(10, 3), (11, 4), (5, 2), (2, 3), (7, 1)])
def test_random_folds_sizes(spark, rows, k):
    df = folds.random_folds(spark.range(rows), "id", k)
    sizes = {r["fold"]: r["count"] for r in df.groupBy("fold").count().collect()}
    size = round(rows / k)
    expected = [min(size, max(0, rows - i * size)) for i in range(k - 1)]
    expected.append(rows - sum(expected))
    assert [sizes.get(i, 0) for i in range(k)] == expected


def test_a_stored_draw_gives_the_same_folds(spark):
    plain = folds.random_folds(spark.range(500), "id", 4)
    stored = folds.random_folds(spark.range(500).withColumn("d", folds.fold_draw("id")), "id", 4, draw="d")
    assert sorted(plain.collect()) == sorted(stored.collect())


def test_folds_do_not_depend_on_partitions(spark):
    found = []
    for parts in [1, 4, 16]:
        df = folds.random_folds(spark.range(1000).repartition(parts), "id", 5)
        found.append(sorted((r["id"], r["fold"]) for r in df.collect()))
    assert found[0] == found[1] == found[2]


@pytest.mark.parametrize("rank_rows", [1, 20, 200_000])
def test_hash_cuts_refine_to_the_same_rows(spark, rank_rows):
    df = spark.range(3000)
    draw = hash32(F.col("id"), "t", seed=1)
    cuts = hash_cuts(df, "id", draw, lambda n: [0, 1, 1499, n - 1, n, 700, 700], rank_rows)
    order = df.select("id", draw.alias("h")).orderBy("h", "id").collect()
    assert [c.key for c in cuts] == [order[p]["id"] for p in [0, 1, 1499, 2999, 700, 700]]


@pytest.mark.parametrize("balance", ["count", "rows"])
@pytest.mark.parametrize("groups,k", [(40, 5), (3, 5)])
def test_group_folds_never_split_a_group(spark, balance, groups, k):
    # One group holds a third of the rows.
    df = spark.range(900).withColumn("g", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % groups))
    folded = folds.group_folds(df, "g", k, balance)
    assert folded.count() == 900
    per_group = folded.groupBy("g").agg(F.count_distinct("fold").alias("f"), F.max("fold").alias("fold"))
    rows = per_group.collect()
    assert all(r["f"] == 1 for r in rows)
    if balance == "count":
        counts = [sum(r["fold"] == i for r in rows) for i in range(k)]
        assert max(counts) - min(counts) <= 1


def test_split_share(spark):
    df = folds.train_test_split(spark.range(100), "id")
    assert df.filter("part = 'test'").count() == 33
    assert folds.train_test_split(spark.range(1), "id").first()["part"] == "test"


def test_fold_copies_by_brute_force(spark):
    rows = [(i, v, i % 3) for i, v in enumerate("aaabbbccdeaaff")]
    df = spark.createDataFrame([(v, f) for _, v, f in rows], "v string, fold int")
    got = {r["fold"]: r for r in folds.fold_copies(df, ["v"], 3).collect()}
    for k in range(3):
        inside = [v for _, v, f in rows if f == k]
        other = [v for _, v, f in rows if f != k]
        assert got[k]["inside_fold"] == len(inside) - len(set(inside))
        assert got[k]["other_folds"] == len(other) - len(set(other))
        assert got[k]["all_folds"] == len(rows) - len({v for _, v, _ in rows})


def test_dummies_and_collisions(spark):
    df = spark.createDataFrame([(1, "x", "x"), (2, "y", "z"), (3, None, "x")], "i int, a string, b string")
    coded = encode.dummies(df, ["a", "b"])
    assert coded.columns == ["i", "x", "y", "b_x", "z"]
    assert [tuple(r) for r in coded.orderBy("i").collect()] == [(1, 1, 0, 1, 0), (2, 0, 1, 0, 1), (3, 0, 0, 1, 0)]
    with pytest.raises(ValueError):
        encode.dummies(df, ["a"], limit=1)


def test_encode_table_reads_number_texts(spark):
    df = spark.createDataFrame([(1.0, "3", "p"), (2.0, "4.5", "q")], "x double, t string, c string")
    coded = encode.encode_table(df)
    assert dict(coded.dtypes) == {"x": "double", "t": "double", "p": "bigint", "q": "bigint"}


def daily(days, seed=0):
    rng = np.random.default_rng(seed)
    start = dt.date(2020, 1, 1)
    return pd.DataFrame(
        [
            (g, start + dt.timedelta(days=2 * i), float(rng.normal()))
            for g in ["a", "b"]
            for i in range(days if g == "a" else days // 3)
        ],
        columns=["g", "d", "x"],
    )


@pytest.mark.parametrize("kind", temporal.KINDS)
def test_window_features_match_pandas(spark, kind):
    """300 days cross several blocks of the weighted sum."""
    data = daily(300)
    df = spark.createDataFrame(data).unionByName(spark.createDataFrame(data.assign(x=0.0)))
    got = temporal.window_features(df, "d", ["x"], ["g"], [1, 2], [1, 2, 5], (kind,)).toPandas()
    got = got.sort_values(["g", "d"]).reset_index(drop=True)
    for lag in [1, 2]:
        for w in [1, 2, 5]:
            by = data.sort_values(["g", "d"]).groupby("g")["x"]
            if kind == "ewm":
                mean = by.transform(lambda s: s.ewm(span=w, adjust=True).mean().shift(lag))
            elif kind == "rolling":
                mean = by.transform(lambda s: s.rolling(w).mean().shift(lag))
            else:
                mean = by.transform(lambda s: s.expanding(w).mean().shift(lag))
            name = temporal.feature_name("x", kind, lag, w)
            np.testing.assert_allclose(got[name].astype(float), mean.to_numpy(), atol=1e-12)


def test_ewm_of_a_long_constant_and_wide_span(spark):
    df = spark.createDataFrame(daily(900).assign(x=7.0))
    got = temporal.window_features(df, "d", ["x"], ["g"], [1], [28], ("ewm",)).toPandas()
    values = got[temporal.feature_name("x", "ewm", 1, 28)].dropna()
    assert np.allclose(values, 7.0, atol=1e-12) and len(values) == len(got) - 2


def test_lag_of_empty_sum_is_zero(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1), None), ("a", dt.date(2020, 1, 2), 2.0)], "g string, d date, x double")
    rows = temporal.lag_features(df, "d", ["x"], ["g"], [1]).orderBy("d").collect()
    assert [r["x_lag_l1"] for r in rows] == [None, 0.0]


def test_fill_dates(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1), 1.0), ("a", dt.date(2020, 1, 4), 2.0)], "g string, d date, x double")
    filled = temporal.fill_dates(df, ["g"], "d").orderBy("d").collect()
    assert [r["x"] for r in filled] == [1.0, 0.0, 0.0, 2.0]


def test_dates_only(spark):
    df = spark.createDataFrame([("a", "2020-01-01", 1.0)], "g string, d string, x double")
    with pytest.raises(TypeError):
        temporal.lag_features(df, "d", ["x"], ["g"], [1])
    assert math.isclose(1.0, df.select(F.month(clean.parse_date("d"))).first()[0])


def test_csv_header_must_fit_the_schema(spark, tmp_path):
    path = tmp_path / "swapped"
    path.mkdir()
    (path / "one.csv").write_text("b,a\n1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_csv(spark, str(path), "a int, b int").collect()
    assert [tuple(r) for r in tables.read_csv(spark, str(path), "b int, a int").collect()] == [(1, 2)]


def test_csv_empty_text_and_line_breaks(spark):
    df = spark.createDataFrame([(1, "", None), (2, None, ""), (3, "a,b", "\\N"), (4, " ", "null")], "i int, s string, t string")
    path = new_path(spark, "csv")
    tables.write_csv(df, path)
    assert sorted(map(tuple, tables.read_csv(spark, path, df.schema).collect())) == sorted(map(tuple, df.collect()))
    broken = spark.createDataFrame([("one\ntwo",), ("three",)], "s string")
    with pytest.raises(Exception, match="line break in s"):
        tables.write_csv(broken, new_path(spark, "csv"))
    path = new_path(spark, "csv")
    tables.write_csv(broken, path, line_breaks=True)
    assert sorted(r["s"] for r in tables.read_csv(spark, path, "s string", multiLine=True).collect()) == ["one\ntwo", "three"]


def test_encoding_dotted_names(spark):
    df = spark.createDataFrame([("x", "1", 2.0), ("y", "2", 3.0), (None, "3", None)], "`a.b` string, `n.o` string, `c.d` double")
    out = encode.encode_table(df)
    assert out.columns == ["n.o", "c.d", "x", "y"]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [(1.0, 2.0, 1, 0), (2.0, 3.0, 0, 1), (3.0, None, 0, 0)]))
