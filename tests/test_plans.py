"""Plans keep what the README promises: few shuffles, pruned scans, no cross joins."""

import re

from pyspark.sql import functions as F

from featurelab.operators import clean, folds, population, profile, temporal
from featurelab.plans.fixtures import sales
from featurelab.plans.registry import all_queries
from featurelab.sources.tables import read_table

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"Exchange (hash|range|Single|RoundRobin)", plan(df)))


def test_folds_need_no_shuffle(spark):
    orders = read_table(spark, FOLDER, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    for df in [
        folds.random_folds(orders, "o_orderkey", 5),
        folds.group_folds(orders, "o_custkey", 5),
        folds.train_test_split(orders, "o_orderkey"),
    ]:
        assert exchanges(df) == 0 and "Join" not in plan(df)


def test_all_window_features_come_from_one_more_shuffle(spark):
    base = sales(spark, FOLDER)
    features = temporal.window_features(base, "date", ["units", "price"], ["agency", "product"], [1, 2, 3], [1, 2, 3, 8, 28])
    assert exchanges(features) == exchanges(base) + 1


def test_the_window_table_reads_its_tables_once(spark):
    found = plan(all_queries()["window_table"](spark, FOLDER))
    assert found.count("FileScan") == plan(sales(spark, FOLDER)).count("FileScan") == 3


def test_generations_need_one_shuffle_in_all(spark):
    runs = spark.range(40).select(
        F.col("id").alias("run_id"), F.lit(10).alias("n"), F.lit(0.5).alias("pc"), F.lit(0.5).alias("pm")
    )
    start = population.random_population(runs, 12)
    final = population.evolve(start, population.ones_score, 3, cut_every=100)
    assert exchanges(final) == 1 and "Join" not in plan(final)


def test_copies_are_counted_in_one_shuffle(spark):
    documents = read_table(spark, FOLDER, "documents").withColumn("fold", (F.col("doc_id") % 3).cast("int"))
    found = plan(folds.fold_copies(documents, ["text", "lang"], 3))
    assert len(re.findall("Exchange hash", found)) == 1 and "Join" not in found


def test_scans_are_pruned_and_filters_pushed(spark):
    lines = read_table(spark, FOLDER, "lineitem")
    keys = read_table(spark, FOLDER, "part").select(F.col("p_partkey").alias("l_partkey"))
    found = plan(clean.members(lines, keys, ["l_partkey"]).filter(F.col("l_returnflag") == "R").select("l_quantity"))
    assert "EqualTo(l_returnflag,R)" in found and "l_comment" not in found and "l_tax" not in found
    counts = plan(profile.outlier_counts(lines, ["l_quantity"]))
    assert "ReadSchema: struct<l_quantity:double>" in counts and "Join" not in counts
