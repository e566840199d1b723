"""Slots and sparse vectors of any number of categories."""

from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from featurelab.operators import encode

LONG = "é" * 5000


def test_vectors_of_odd_categories(spark):
    rows = [(1, "b", 2.5), (2, None, 1.0), (3, "", None), (4, LONG, 1.0), (5, "b", 2.5), (5, "b", 2.5)]
    df = spark.createDataFrame(rows, "id int, `k.x` string, _value_0 double")
    got = encode.dummy_vector(df, ["k.x", "_value_0"], "flags")
    assert got.columns == ["id", "k.x", "_value_0", "flags"] and got.count() == 6
    # Slots: "", b, the long text, NULL; then 1.0, 2.5, NULL.
    want = {1: [1, 5], 2: [3, 4], 3: [0, 6], 4: [2, 4], 5: [1, 5]}
    for r in got.collect():
        assert r["flags"] == SparseVector(7, want[r["id"]], [1.0, 1.0])


def test_empty_tables_and_null_columns(spark):
    none = spark.createDataFrame([], "id int, k string")
    assert encode.dummy_vector(none, ["k"], "v").count() == 0 and encode.dictionary(none, "k").count() == 0
    nulls = spark.createDataFrame([(1, None), (2, None)], "id int, k string")
    assert [r["v"] for r in encode.dummy_vector(nulls, ["k"], "v").collect()] == [SparseVector(1, [0], [1.0])] * 2


def test_as_many_categories_as_rows(spark, monkeypatch):
    df = spark.range(50_000).select("id", F.concat(F.lit("name#"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("k"))
    wrong = encode.dictionary(df, "k").where(F.col("value") != F.concat(F.lit("name#"), F.lpad(F.col("index").cast("string"), 9, "0")))
    assert wrong.isEmpty()
    monkeypatch.setattr("featurelab.operators.sized.BROADCAST_BYTES", 1000)  # beyond the bound: a shuffle
    coded, size = encode.dummy_slots(df, ["k"], "slots")
    assert size == 50_001 and coded.where(F.col("slots")[0] != F.col("id")).isEmpty()
    assert coded.count() == 50_000
