"""Train/test splits and folds as a ``fold`` column.

A fold is a section of the hash order of a key. Counting finds the few rows where
sections meet; every other row learns its fold from its own hash. Exact fold sizes
thus cost two narrow scans, and the table is neither shuffled nor joined.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurelab.functions.draws import SEED, hash32
from featurelab.operators.ranks import SPREAD_BUCKETS, hash_cuts, ordered_position, section
from featurelab.operators.sized import broadcast_if_small
from featurelab.sources.work import materialize

TEST_SHARE = 0.33


def train_test_split(
    df: DataFrame, key: str, test_share: float = TEST_SHARE, seed: int = SEED, out: str = "part"
) -> DataFrame:
    """Mark ``ceil(test_share * rows)`` rows as test, drawn by hash; ``key`` must be unique."""
    draw = hash32(F.col(key), "split", seed=seed)
    cuts = hash_cuts(df, key, draw, lambda rows: [math.ceil(test_share * rows)])
    part = F.when(section(key, draw, cuts) == 0, "test").otherwise("train")
    return df.withColumn(out, part)


def fold_draw(key: str, seed: int = SEED) -> Column:
    """The hash that orders rows into folds. A table that is written once and scanned often
    may store it, and ``random_folds`` then only compares numbers."""
    return hash32(F.col(key), "fold", seed=seed)


def random_folds(
    df: DataFrame, key: str, folds: int, seed: int = SEED, out: str = "fold", draw: str | None = None
) -> DataFrame:
    """Folds of round(rows/folds) rows each (halves to even); the last takes the rest.

    ``key`` must be unique and is never a feature. ``draw`` names a stored ``fold_draw``,
    which is used up.
    """
    drawn = F.col(draw) if draw else fold_draw(key, seed)

    def starts(rows: int) -> list[int]:
        return [k * round(rows / folds) for k in range(1, folds)]

    cuts = hash_cuts(df, key, drawn, starts)
    folded = df.withColumn(out, section(key, drawn, cuts).cast("int"))
    return folded.drop(draw) if draw else folded


def group_folds(
    df: DataFrame, group: str, folds: int, balance: str = "count", seed: int = SEED, out: str = "fold"
) -> DataFrame:
    """Folds that never split a group.

    ``balance="count"`` gives every fold the same number of groups (within one) from the
    group's hash alone. ``balance="rows"`` deals the groups out in snake order of their
    row count, so that the folds hold similar numbers of rows.
    """
    if balance == "count":
        groups = materialize(df.select(group).distinct(), "groups")

        def starts(rows: int) -> list[int]:
            return [rows * k // folds for k in range(1, folds)]

        draw = fold_draw(group, seed)
        return df.withColumn(out, section(group, draw, hash_cuts(groups, group, draw, starts)).cast("int"))
    if balance != "rows":
        raise ValueError("balance is 'count' or 'rows'")
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_rows")).withColumns(
        {"_draw": fold_draw(group, seed)}
    )
    # Larger groups first; the hash spreads the many groups of one size over the ranges.
    sizes = materialize(sizes, "groups")
    sizes = sizes.withColumn("_key", -F.col("_rows") + F.col("_draw") / F.lit(2.0**32))
    order = [F.col("_rows").desc(), F.col("_draw"), F.col(group)]
    dealt = ordered_position(sizes, "_key", order, "_place", SPREAD_BUCKETS)
    lap, step = F.floor(F.col("_place") / folds), F.col("_place") % folds
    snake = F.when(lap % 2 == 0, step).otherwise(folds - 1 - step)
    # A hot group only repeats on the large side; its fold table has one row per group.
    return df.join(broadcast_if_small(dealt.select(group, snake.cast("int").alias(out))), group)


def train_rows(df: DataFrame, fold: int, out: str = "fold") -> DataFrame:
    return df.filter(F.col(out) != fold)


def test_rows(df: DataFrame, fold: int, out: str = "fold") -> DataFrame:
    return df.filter(F.col(out) == fold)


def fold_means(df: DataFrame, target: str, fold: str = "fold") -> DataFrame:
    """Mean target of each fold and, with a NULL fold, of all rows."""
    return df.rollup(fold).agg(F.avg(target).alias("mean"), F.count(target).alias("rows"))


def fold_copies(df: DataFrame, features: list[str], folds: int, fold: str = "fold") -> DataFrame:
    """Per fold: copied rows inside it, in the other folds, in all, and their share.

    One shuffle for all folds: copies are folded map-side to one row of fold counts, and
    texts travel as their digest.
    """
    types = dict(df.dtypes)
    keys = [
        F.sha2(F.col(f"`{c}`"), 256).alias(f"_k{i}") if types[c] == "string" else F.col(f"`{c}`").alias(f"_k{i}")
        for i, c in enumerate(features)
    ]
    counted = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(fold) == k).alias(f"in{k}") for k in range(folds)],
    )
    copies = counted.agg(
        F.sum("n").alias("rows"),
        F.sum(F.col("n") - 1).alias("all_folds"),
        *[F.sum(F.greatest(F.col(f"in{k}") - 1, F.lit(0))).alias(f"in{k}") for k in range(folds)],
        *[
            F.sum(F.greatest(F.col("n") - F.col(f"in{k}") - 1, F.lit(0))).alias(f"out{k}")
            for k in range(folds)
        ],
    )
    per_fold = [
        F.struct(
            F.lit(k).alias("fold"),
            F.col(f"in{k}").alias("inside_fold"),
            F.col(f"out{k}").alias("other_folds"),
            F.col("all_folds"),
            (F.col("all_folds") / F.col("rows")).alias("share"),
        )
        for k in range(folds)
    ]
    return copies.select(F.inline(F.array(*per_fold)))
