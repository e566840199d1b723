"""Cleaning of column names and category values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The signs replaced by '_', in this order; last, double '_' becomes one.
SIGNS = [" ", ".", "/", "(", ")", "-", "%", "'", "[", "]", "{", "}", "=", "?", "__"]


def clean_name(name: str) -> str:
    return reduce(lambda text, sign: text.replace(sign, "_"), SIGNS, name)


def clean_columns(df: DataFrame) -> DataFrame:
    """Rename every column; only the schema changes. Of names that become equal, ignoring case, the
    later ones get a number: ``a b`` and ``a.b`` become ``a_b`` and ``a_b_2``."""
    taken: set[str] = set()
    names = []
    for name in map(clean_name, df.columns):
        number, free = 1, name
        while free.lower() in taken:
            number += 1
            free = f"{name}_{number}"
        taken.add(free.lower())
        names.append(free)
    return df.toDF(*names)


def clean_value(value: Column) -> Column:
    return reduce(lambda text, sign: F.replace(text, F.lit(sign), F.lit("_")), SIGNS, value)


def clean_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Clean the values of the given (by default all) string columns."""
    names = columns or [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    return df.withColumns({c: clean_value(F.col(f"`{c}`")) for c in names})
