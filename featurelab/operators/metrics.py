"""Scores of predictions, over all rows or by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from featurelab.operators.ranks import SPREAD_BUCKETS, range_bucket
from featurelab.sources.work import materialize

_SMALLEST_P = 1e-15


def mae(target: Column, prediction: Column) -> Column:
    return F.avg(F.abs(target - prediction))


def mse(target: Column, prediction: Column) -> Column:
    return F.avg((target - prediction) * (target - prediction))


def rmse(target: Column, prediction: Column) -> Column:
    return F.sqrt(mse(target, prediction))


def r2(target: Column, prediction: Column) -> Column:
    """1 - residual / total sum of squares; NULL for a constant target."""
    return 1 - F.try_divide(mse(target, prediction), F.var_pop(target))


METRICS = {"mae": mae, "mse": mse, "rmse": rmse, "r2": r2}


def regression_report(
    df: DataFrame, target: str = "y", prediction: str = "prediction", by: list[str] | None = None
) -> DataFrame:
    """Rows and errors, by group if asked. NaN counts as NULL: such rows are counted, and in no error."""
    t, p = (F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`")) for c in (target, prediction))
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(t - p).alias("mean_residual"),
        *[metric(t, p).alias(name) for name, metric in METRICS.items()],
    )


def accuracy(label: Column, predicted: Column) -> Column:
    return F.avg((label == predicted).cast("double"))


def error_rate(label: Column, predicted: Column) -> Column:
    return F.avg((label != predicted).cast("double"))


def _clipped(p: Column) -> Column:
    return F.greatest(F.lit(_SMALLEST_P), F.least(F.lit(1 - _SMALLEST_P), p))


def log_loss(label: Column, probability: Column) -> Column:
    p = _clipped(probability)
    return F.avg(-F.ln(F.when(label == 1, p).otherwise(1 - p)))


def multiclass_log_loss(label: Column, probabilities: Column) -> Column:
    """``probabilities`` is an array with one entry per class 0, 1, ..."""
    return F.avg(-F.ln(_clipped(F.element_at(probabilities, label.cast("int") + 1))))


def roc_auc(
    df: DataFrame,
    label: str,
    score: str,
    by: list[str] | None = None,
    buckets: int = SPREAD_BUCKETS,
) -> DataFrame:
    """Exact area under the ROC curve, ties counted half.

    Rows are folded to distinct scores map-side, the scores are split into ranges, each
    range is swept on its own, and the ranges are combined from their class counts.
    """
    keys = by or []
    cells = df.groupBy(*keys, F.col(score).cast("double").alias("_score")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")
    )
    # Written once; the bounds are sketched from the distinct scores, so that no range grows with a hot one.
    ranged = range_bucket(materialize(cells, "scores"), "_score", "_range", buckets)
    inside = Window.partitionBy(*keys, "_range").orderBy("_score")
    below = F.coalesce(
        F.sum("_neg").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    swept = ranged.withColumn("_area", F.col("_pos") * (below + F.col("_neg") / 2))
    ranges = swept.groupBy(*keys, "_range").agg(
        F.sum("_area").alias("_area"), F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg")
    )  # at most buckets + 1 rows per group
    order = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_neg").over(order), F.lit(0))
    total = ranges.withColumn("_area", F.col("_area") + F.col("_pos") * before)
    return total.groupBy(*keys).agg(
        F.try_divide(F.sum("_area"), (F.sum("_pos") * F.sum("_neg")).cast("double")).alias("auc")
    )
