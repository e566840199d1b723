"""Describing columns: statistics, categories, outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType, StringType

from featurelab.functions.names import clean_columns, clean_values
from featurelab.operators.clean import clamp_negative
from featurelab.operators.ranks import exact_quantiles
from featurelab.operators.sized import BROADCAST_ROWS, broadcast_if_small

# Outlier distances in standard deviations and rare-category shares.
DEVIATIONS = [1.0, 2.0, 2.5, 3.0]
RARE_SHARE = 0.05
VERY_RARE_SHARE = 0.01


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, StringType)]


def plain_column(column: str) -> Column:
    """The column of just this name, whatever signs are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def _double(column: str) -> Column:
    return plain_column(column).cast("double")


def without_nan(df: DataFrame) -> DataFrame:
    """NaN of floating columns as NULL: both mean that there is no value."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, (FloatType, DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(plain_column(c)), plain_column(c)) for c in floating})


def group_sum(df: DataFrame, keys: list[str], values: list[str] | None = None) -> DataFrame:
    """Sum of the numeric columns by key; a group with no value sums to 0."""
    names = values or [c for c in numeric_columns(df) if c not in keys]
    grouped = without_nan(df).groupBy(*[plain_column(k) for k in keys])
    return grouped.agg(*[F.coalesce(F.sum(plain_column(c)), F.lit(0)).alias(c) for c in names])


def classify_columns(df: DataFrame) -> DataFrame:
    """One row per column: is it numeric, or text whose every value reads as a number?"""
    checks = []
    for f in df.schema:
        name = F.lit(f.name).alias("column")
        if isinstance(f.dataType, NumericType):
            numeric = F.lit(1)
        elif isinstance(f.dataType, StringType):
            value = plain_column(f.name)
            numeric = (F.count(value) == F.count(value.try_cast("double"))).cast("int")
        else:
            numeric = F.lit(0)
        checks.append(F.struct(name, numeric.cast("bigint").alias("is_numeric")))
    return df.agg(F.array(*checks).alias("c")).select(F.inline("c"))


def describe_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, std (n-1), min, quartiles and max, one row per column; NaN counts as NULL."""
    names = columns or numeric_columns(df)
    df = without_nan(df)
    quartiles = exact_quantiles(df, names, [0.25, 0.5, 0.75])
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(plain_column(c)).alias("count"),
            F.avg(_double(c)).alias("mean"),
            F.stddev_samp(plain_column(c)).alias("std"),
            F.min(plain_column(c)).cast("double").alias("min"),
            *[
                F.lit(quartiles[c, p]).cast("double").alias(alias)
                for p, alias in [(0.25, "q25"), (0.5, "q50"), (0.75, "q75")]
            ],
            F.max(plain_column(c)).cast("double").alias("max"),
        )
        for c in names
    ]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def _values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long (column, value) rows of the named string columns, NULLs left out."""
    pairs = [
        F.when(
            plain_column(c).isNotNull(),
            F.struct(F.lit(c).alias("column"), plain_column(c).alias("value")),
        )
        for c in columns
    ]
    return df.select(F.explode(F.array_compact(F.array(*pairs))).alias("p")).select("p.*")


def category_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, count) for all string columns from one scan and one shuffle."""
    return (
        _values(df, columns or string_columns(df))
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def describe_strings(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Non-null count, distinct values and the top value (ties: smallest text first).

    A column without a value has count and unique 0 and no top."""
    names = columns or string_columns(df)
    told = (
        category_counts(df, names)
        .groupBy("column")
        .agg(
            F.sum("count").alias("count"), F.count(F.lit(1)).alias("unique"),
            F.min(F.struct((-F.col("count")).alias("less"), "value")).alias("first"),
        )
    )
    every = df.sparkSession.createDataFrame([(c,) for c in names], "column string")
    return every.join(told, "column", "left").select(
        "column", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("unique", F.lit(0)).alias("unique"),
        F.col("first.value").alias("top"), (-F.col("first.less")).alias("top_count"),
    )


def rare_categories(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Share of all rows of each category, with flags below 5 % and below 1 %."""
    rows = df.agg(F.count(F.lit(1))).scalar()
    share = F.col("length") / rows
    return (
        category_counts(df, columns)
        .withColumnRenamed("count", "length")
        .withColumn("length_pct", share)
        .withColumns(
            {
                "rare": (F.col("length_pct") < RARE_SHARE).cast("bigint"),
                "very_rare": (F.col("length_pct") < VERY_RARE_SHARE).cast("bigint"),
            }
        )
    )


def _moments(df: DataFrame, columns: list[str]) -> Column:
    stats = df.agg(
        F.struct(
            *[F.avg(_double(c)).alias(f"mean_{c}") for c in columns],
            *[F.stddev_samp(plain_column(c)).alias(f"std_{c}") for c in columns],
        )
    )
    return stats.scalar()


def outlier_counts(
    df: DataFrame, columns: list[str] | None = None, deviations: list[float] | None = None
) -> DataFrame:
    """Rows at or above mean + k standard deviations, for each column and k: two scans, no join."""
    names = columns or numeric_columns(df)
    df = without_nan(df)
    moments = _moments(df, names)
    cells = []
    for c in names:
        for k in deviations or DEVIATIONS:
            threshold = moments[f"mean_{c}"] + moments[f"std_{c}"] * k
            cells.append(
                F.struct(
                    F.lit(c).alias("column"),
                    F.lit(k).alias("k"),
                    F.first(threshold).alias("threshold"),
                    F.count_if(_double(c) >= threshold).alias("count"),
                )
            )
    return df.agg(F.array(*cells).alias("r")).select(F.inline("r"))


def fold_rare(
    df: DataFrame, column: str, share: float, max_broadcast: int = BROADCAST_ROWS
) -> DataFrame:
    """Replace categories rarer than ``share`` of the rows by the most frequent one."""
    counts = category_counts(df, [column]).select("value", "count")
    rows = df.agg(F.count(F.lit(1))).scalar()
    top = describe_strings(df, [column]).select("top").scalar()
    rare = counts.filter(F.col("count") / rows < share).select(
        F.col("value").alias(column), F.lit(True).alias("_rare")
    )
    marked = df.join(broadcast_if_small(rare, max_broadcast), column, "left")
    value = F.when(F.col("_rare"), top).otherwise(plain_column(column))
    return marked.withColumn(column, value).drop("_rare").select(*[plain_column(c) for c in df.columns])


def z_score(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / std (n-1); a constant column gives NULL, and so does NaN."""
    df = without_nan(df)
    moments = _moments(df, columns)
    return df.withColumns(
        {
            c: F.try_divide(_double(c) - moments[f"mean_{c}"], moments[f"std_{c}"])
            for c in columns
        }
    )


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Scale to [0, 1]; a constant column gives 0, NaN gives NULL."""
    df = without_nan(df)
    ends = df.agg(
        F.struct(
            *[F.min(_double(c)).alias(f"min_{c}") for c in columns],
            *[F.max(_double(c)).alias(f"max_{c}") for c in columns],
        )
    ).scalar()
    scaled = {}
    for c in columns:
        low, high = ends[f"min_{c}"], ends[f"max_{c}"]
        scaled[c] = F.when(high == low, _double(c) * 0.0).otherwise((_double(c) - low) / (high - low))
    return df.withColumns(scaled)


def medians_and_mads(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Median and median absolute deviation of each column, exact; all columns together. NaN counts as
    NULL; a column without a value has None for both."""
    medians = exact_quantiles(df, columns, [0.5])
    away = df.select(*[F.abs(_double(c) - F.lit(medians[c, 0.5])).alias(c) for c in columns])
    mads = exact_quantiles(away, columns, [0.5])
    return {c: (medians[c, 0.5], mads[c, 0.5]) for c in columns}


def median_and_mad(df: DataFrame, column: str) -> tuple[float, float]:
    return medians_and_mads(df, [column])[column]


def mad_outlier(column: Column, median: float | None, mad: float | None, threshold: float) -> Column:
    """Whether a value is off the median by more than ``threshold`` MADs; of no values, none is."""
    if mad is None:
        return F.lit(False)
    if mad == 0:
        return column != median
    return F.abs(column - median) / mad > threshold


def label_likes(df: DataFrame, column: str, threshold: float, out: str = "like") -> DataFrame:
    """Clamp negatives, then label: outliers 2 above the smallest regular value, else 0;
    regular values 1 above their mean, else 0. NULL and NaN, which comes out as NULL, are labelled 0.

    Whether a value is an outlier depends on the value alone, so no row can be both
    and the two sides need no join.
    """
    df = without_nan(df)
    data = df.withColumn(column, clamp_negative(_double(column)))
    median, mad = median_and_mad(data, column)
    value = plain_column(column)
    outlier = F.coalesce(mad_outlier(value, median, mad, threshold), F.lit(False))
    regular = data.filter(~outlier).agg(
        F.struct(F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"))
    ).scalar()
    above = (value > regular["mean"]) & (regular["high"] > regular["low"])
    return data.withColumn(
        out,
        F.when(outlier, F.when(value > regular["low"], 2).otherwise(0))
        .otherwise(F.when(above, 1).otherwise(0))
        .cast("bigint"),
    )


class Profile:
    """A table with clean column names and the reports on it."""

    def __init__(self, df: DataFrame):
        self.data = clean_columns(df)

    def numeric(self) -> DataFrame:
        return describe_numeric(self.data)

    def strings(self) -> DataFrame:
        return describe_strings(self.data)

    def categories(self) -> DataFrame:
        return rare_categories(self.data)

    def outliers(self) -> DataFrame:
        return outlier_counts(self.data)

    def with_clean_values(self) -> Profile:
        return Profile(clean_values(self.data))

    def with_rare_folded(self, column: str, share: float) -> Profile:
        return Profile(fold_rare(self.data, column, share))
