"""Generations of runs that are larger than a task.

The steps of ``population`` sort a run in one window. Here the whole table is dealt out by
ranges of (run, score, source, idx) instead, so that no task holds more than about
``part_rows`` individuals, even if all of them have the same score; each part is numbered on
its own and shifted by the rows of its run before it. Results are the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from featurelab.functions.draws import SEED
from featurelab.operators import population as pop
from featurelab.operators.sized import broadcast_if_small
from featurelab.sources.work import materialize

PART_ROWS = 1_000_000


def placed(population: DataFrame, order: list[Column], out: str, part_rows: int = PART_ROWS) -> DataFrame:
    """0-based position within the run in ``order``, which has to tell the rows of a run apart.

    The parts are written before they are numbered: a part that is read again is the same."""
    written = materialize(population, "run")
    parts = max(1, -(-written.count() // part_rows))
    ranges = written.repartitionByRange(parts, "run_id", *order).withColumn("_part", F.spark_partition_id())
    ranges = materialize(ranges, "ranges")
    sizes = ranges.groupBy("run_id", "_part").agg(F.count(F.lit(1)).alias("_rows"))  # at most parts + runs rows
    before = Window.partitionBy("run_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("run_id", "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("run_id", "_part").orderBy(*order)
    return (
        ranges.withColumn("_row", F.row_number().over(inside) - 1)
        .join(broadcast_if_small(shifts), ["run_id", "_part"])
        .withColumn(out, F.col("_shift") + F.col("_row"))
        .drop("_part", "_row", "_shift")
    )


def ranked(population: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """As ``population.ranked``; ``idx`` is unique within a run. Rows without a score come last."""
    order = [F.col("score").desc_nulls_last(), F.col("idx")]
    return placed(population, order, "_place", part_rows).drop("idx").withColumnRenamed("_place", "idx")


def crossed(population: DataFrame, generation, pc: Column | float, seed: int = SEED, out: str = "genome") -> DataFrame:
    """As ``population.crossed``: sizes come from an aggregate, partners from a window over the pair."""
    sizes = population.groupBy("run_id").agg(F.count(F.lit(1)).alias("_size"))
    sized = population.join(broadcast_if_small(sizes), "run_id")
    return pop.crossed(sized, generation, pc, seed, out, size=F.col("_size")).drop("_size")


def keep_best(pool: DataFrame, n: Column | int, part_rows: int = PART_ROWS) -> DataFrame:
    """As ``population.keep_best``; (source, idx) is unique within a run."""
    order = [F.col("score").desc_nulls_last(), F.col("source"), F.col("idx")]
    kept = placed(pool, order, "_place", part_rows).filter(F.col("_place") < n)
    return kept.drop("source", "idx").withColumnRenamed("_place", "idx")


def generation(
    population: DataFrame, number: int, score: Callable[[DataFrame], DataFrame], seed: int = SEED, part_rows: int = PART_ROWS
) -> DataFrame:
    """Rank, cross, mutate, score and keep the best of runs of any size; an empty table stays empty.

    ``population`` has run_id, n, pc, pm, idx, genome and score; n individuals of a run are kept.
    """
    parents = materialize(ranked(population, part_rows), "parents")
    children = pop.mutated(crossed(parents, number, F.col("pc"), seed), number, F.col("pm"), seed)
    pool = score(children.drop("score")).withColumn("source", F.lit(0)).unionByName(parents.withColumn("source", F.lit(1)))
    return keep_best(pool, F.col("n"), part_rows)
