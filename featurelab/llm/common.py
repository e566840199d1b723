"""Small helpers the text operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def number_within(df: DataFrame, keys: list[str], part: str, out: str) -> DataFrame:
    """0-based, gapless numbers of the rows of each key, from numbers within parts.

    ``df`` must hold ``out`` as the row's 0-based number within (keys, part); the rows of
    earlier parts are added to it. The window sees one row per (keys, part), never the data.
    """
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        df.groupBy(*keys, part)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_shift", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    return (
        df.join(shifts, [*keys, part])
        .withColumn(out, (F.col(out) + F.col("_shift")).cast("bigint"))
        .drop("_shift")
    )
