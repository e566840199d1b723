"""Lagged time-series features per category group.

Each function sums the values by (categories, date) first, so that a group holds at
most one row per day, however many raw rows fall on it: the windows below are bounded
by the calendar, and a hot group is folded map-side before it is ever shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType
from pyspark.sql.window import Window

from featurelab.operators.profile import group_sum

KINDS = ("ewm", "rolling", "expanding")
# Weights below this share of the newest one do not change a double sum.
_FADED = 1e-40
# Largest natural logarithm of a weight inside a block.
_STEEPEST = 575.0


def series(df: DataFrame, date: str, values: list[str], categories: list[str]) -> DataFrame:
    if not isinstance(df.schema[date].dataType, DateType):
        raise TypeError(f"{date} must be a date column")
    return group_sum(df, [*categories, date], values)


def feature_name(value: str, kind: str, lag: int, width: int | None = None) -> str:
    return f"{value}_{kind}_l{lag}" + ("" if width is None else f"_w{width}")


def _windowed(value: str, kind: str, lag: int, width: int, order) -> Column:
    if kind == "rolling":
        frame = order.rowsBetween(-(lag + width - 1), -lag)
        full = F.count(value).over(frame) == width
    else:
        frame = order.rowsBetween(Window.unboundedPreceding, -lag)
        full = F.count(value).over(frame) >= width
    return F.when(full, F.avg(value).over(frame))


def _blocks(widths: list[int]) -> list[tuple[int, list[int]]]:
    """Widths that can share a block of rows, and its length.

    A block is long enough for the slowest weights to fade over it and short enough for
    the fastest ones, taken backwards, to stay a finite double.
    """
    groups: list[tuple[int, list[int]]] = []
    for width in sorted(set(widths)):
        pace = -math.log(1.0 - 2.0 / (width + 1.0))
        needed = math.ceil(-math.log(_FADED) / pace)
        if groups and needed * -math.log(1.0 - 2.0 / (groups[-1][1][0] + 1.0)) < _STEEPEST:
            groups[-1] = (needed, [*groups[-1][1], width])
        else:
            groups.append((needed, [width]))
    return groups


def _add_weighted(
    data: DataFrame, values: list[str], categories: list[str], lags: list[int], widths: list[int]
) -> DataFrame:
    """Exponentially weighted means, span ``width``, adjusted weights, up to ``lag`` rows back.

    A running sum restarts every block of rows, in which later rows weigh more; the block
    before enters through its last sum, and older ones have faded to nothing. All windows
    of a block length share one sort.
    """
    for block, shared in _blocks([w for w in widths if w > 1]):
        step = F.col("_row") % block
        data = data.withColumn("_block", F.floor(F.col("_row") / block))
        order = Window.partitionBy(*categories).orderBy("_block", "_row")
        inside = Window.partitionBy(*categories, "_block").orderBy("_row")
        running = inside.rowsBetween(Window.unboundedPreceding, 0)
        earlier = order.rowsBetween(Window.unboundedPreceding, -1)
        pairs = [(v, w, F.lit(1.0 - 2.0 / (w + 1.0))) for v in values for w in shared]
        data = data.withColumns(
            {
                f"_local_{v}_{w}": F.sum(F.col(v) * F.pow(keep, -step)).over(running) * F.pow(keep, step)
                for v, w, keep in pairs
            }
        )
        last_row = F.col("_row") % block == block - 1
        means = {}
        for v, w, keep in pairs:
            closed = F.last(F.when(last_row, F.col(f"_local_{v}_{w}")), ignorenulls=True).over(earlier)
            total = F.col(f"_local_{v}_{w}") + F.coalesce(closed, F.lit(0.0)) * F.pow(keep, step + 1)
            weight = (1.0 - F.pow(keep, F.col("_row") + 1)) / (1.0 - keep)
            means[f"_mean_{v}_{w}"] = total / weight
        data = data.withColumns(means).withColumns(
            {
                feature_name(v, "ewm", n, w): F.lag(f"_mean_{v}_{w}", n).over(order)
                for v, w, _ in pairs
                for n in lags
            }
        )
    return data


def lag_features(
    df: DataFrame, date: str, values: list[str], categories: list[str], lags: list[int]
) -> DataFrame:
    """The summed value ``lag`` rows earlier in its group."""
    order = Window.partitionBy(*categories).orderBy(date)
    data = series(df, date, values, categories)
    lagged = {feature_name(v, "lag", n): F.lag(v, n).over(order) for v in values for n in lags}
    return data.withColumns(lagged)


def window_features(
    df: DataFrame,
    date: str,
    values: list[str],
    categories: list[str],
    lags: list[int],
    widths: list[int],
    kinds: tuple[str, ...] = KINDS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Means over the rows up to ``lag`` rows back, for every value, kind, lag and width.

    rolling: the last ``width`` rows, NULL if there are fewer; expanding: all rows, NULL
    below ``width``; ewm: all rows, weighted with span ``width``. All of them come from
    one shuffle and sort by category group. Returns the keys, the sums of the ``keep``
    columns, which so need no join with the table, and the features.
    """
    order = Window.partitionBy(*categories).orderBy(date)
    wanted = [(v, k, n, w) for v in values for k in kinds for n in lags for w in widths]
    direct = {"_row": F.row_number().over(order) - 1}
    for v, k, n, w in wanted:
        if k != "ewm":
            direct[feature_name(v, k, n, w)] = _windowed(v, k, n, w, order)
        elif w == 1:  # all weight on the newest row
            direct[feature_name(v, k, n, w)] = F.lag(v, n).over(order)
    data = series(df, date, list(dict.fromkeys([*values, *keep])), categories).withColumns(direct)
    if "ewm" in kinds:
        data = _add_weighted(data, values, categories, lags, widths)
    return data.select(*categories, date, *keep, *[feature_name(*f) for f in wanted])


def fill_dates(
    df: DataFrame, ids: list[str], date: str, values: list[str] | None = None
) -> DataFrame:
    """One row per day between the first and the last day of each id, missing values 0.

    Days are sums of the given rows, so both sides hold one row per id and day and the
    join key is unique.
    """
    names = values or [c for c in df.columns if c not in (*ids, date)]
    known = series(df, date, names, ids)
    spans = df.groupBy(*ids).agg(F.min(date).alias("first"), F.max(date).alias("last"))
    every = spans.select(
        *ids, F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias(date)
    )
    filled = every.join(known, [*ids, date], "left")
    return filled.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in names})
