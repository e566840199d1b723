"""Generations in parts against generations in one window."""

import pytest
from pyspark.sql import functions as F

from featurelab.operators import large_runs
from featurelab.operators import population as pop


def people(spark, same_score=False):
    """A run of 300, one of 7, one of a single individual."""
    sizes = spark.createDataFrame([(1, 300), (2, 7), (3, 1)], "run_id long, n int")
    start = pop.random_population(sizes.withColumns({"pc": F.lit(0.7), "pm": F.lit(0.5)}), 12)
    scored = pop.ones_score(start)
    return scored.withColumn("score", F.lit(1.0)) if same_score else scored


def rows(df):
    return sorted((r["run_id"], r["idx"], r["genome"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("part_rows", [17, 1_000_000])
@pytest.mark.parametrize("same", [False, True])
def test_ranks_and_choice_equal_the_window(spark, part_rows, same):
    start = people(spark, same)
    assert rows(large_runs.ranked(start, part_rows)) == rows(pop.ranked(start))
    pool = start.withColumn("source", F.col("idx") % 2)
    assert rows(large_runs.keep_best(pool, 100, part_rows)) == rows(pop.keep_best(pool, 100))


def test_no_part_holds_a_hot_score(spark):
    start = people(spark, same_score=True)
    held = []
    real = large_runs.materialize

    def watched(df, name):
        table = real(df, name)
        if name == "ranges":
            held.extend(r["count"] for r in table.groupBy("_part").count().collect())
        return table

    large_runs.materialize = watched
    try:
        large_runs.ranked(start, 20)
    finally:
        large_runs.materialize = real
    assert len(held) >= 12 and max(held) <= 60


def test_generation_equals_the_steps_in_one_window(spark):
    start = people(spark)
    parents = pop.ranked(start)
    children = pop.mutated(pop.crossed(parents, 4, F.col("pc")), 4, F.col("pm")).drop("score")
    want = pop.select_best(parents, pop.ones_score(children), F.col("n"))
    assert rows(large_runs.generation(start, 4, pop.ones_score, part_rows=40)) == rows(want)


def test_empty_runs_and_missing_scores(spark):
    empty = people(spark).filter("run_id > 9")
    assert large_runs.generation(empty, 0, pop.ones_score).count() == 0
    some = people(spark).withColumn("score", F.when(F.col("idx") % 3 > 0, F.col("score")))
    got = {(r["run_id"], r["genome"], r["idx"]) for r in large_runs.ranked(some, 30).collect()}
    assert got == {(r["run_id"], r["genome"], r["idx"]) for r in pop.ranked(some).collect()}
