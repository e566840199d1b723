"""Row and column preparation: projections, filters, dates, prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns)


def discard(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def prefixed(column: str, prefix: str) -> Column:
    """An id as text behind a literal prefix."""
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def parse_date(column: str) -> Column:
    return F.to_date(F.col(column), "yyyy-MM-dd")


def calendar_parts(df: DataFrame, date: str, month: str = "month", year: str = "year") -> DataFrame:
    return df.withColumns({month: F.month(date), year: F.year(date)})


def complete_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without any NULL."""
    return df.na.drop("any", subset=columns)


def clamp_negative(column: Column) -> Column:
    """Negative values become 0; NULL stays NULL."""
    return F.when(column < 0, F.lit(0.0)).otherwise(column)


def labelled(column: Column, equal_to, then: str, otherwise: str) -> Column:
    return F.when(column == equal_to, F.lit(then)).otherwise(F.lit(otherwise))


def members(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key occurs in ``keys``. Duplicate keys there never repeat a row."""
    return df.join(keys.select(*on), on, "left_semi")


def non_members(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on), on, "left_anti")


def distinct_rows(df: DataFrame) -> DataFrame:
    """Copies are folded map-side before the shuffle, so a hot group of copies stays small."""
    return df.dropDuplicates()


def aligned_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on key columns. AQE picks the join and splits skewed keys."""
    return left.join(right, keys, "inner")


def stack_rows(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, columns matched by name."""
    head, *rest = frames
    for frame in rest:
        head = head.unionByName(frame)
    return head
