"""Time-series features of the sales series."""

from __future__ import annotations

from pyspark.sql import functions as F

from featurelab.operators import temporal
from featurelab.plans.fixtures import SALES, rounded, sales

QUERIES, ORACLE = {}, {}

_GROUP = ["agency", "product"]
_LAGS, _WIDTHS = [1, 2], [1, 2, 3]


def _text_keys(df, names):
    """Weighted means are rounded; plain means of whole units agree to the last bit."""
    keys = [F.col("agency").cast("bigint"), F.col("product"), F.col("date").cast("string")]
    return df.select(*keys, *[rounded(n).alias(n) if "_ewm_" in n or n == "price" else n for n in names])


def lag_features(spark, sf):
    lagged = temporal.lag_features(sales(spark, sf), "date", ["units", "price"], _GROUP, _LAGS)
    names = [temporal.feature_name(v, "lag", n) for v in ["units", "price"] for n in _LAGS]
    return lagged.select(
        F.col("agency").cast("bigint"), "product", F.col("date").cast("string"),
        *[rounded(n, 2).alias(n) for n in names],
    )


def _kind(kind):
    def query(spark, sf):
        features = temporal.window_features(
            sales(spark, sf), "date", ["units"], _GROUP, _LAGS, _WIDTHS, (kind,)
        )
        return _text_keys(features, features.columns[3:])

    return query


def window_table(spark, sf):
    """All kinds of features beside the summed table, rows with a NULL dropped."""
    features = temporal.window_features(sales(spark, sf), "date", ["units"], _GROUP, _LAGS, [2], keep=["price"])
    return _text_keys(features.na.drop("any"), features.columns[3:])


def fill_dates(spark, sf):
    by_agency = sales(spark, sf).select("agency", "date", "units")
    filled = temporal.fill_dates(by_agency, ["agency"], "date")
    return filled.select(
        F.col("agency").cast("bigint"), F.col("date").cast("string"), rounded("units", 2).alias("units")
    )


QUERIES.update(
    lag_features=lag_features, rolling_features=_kind("rolling"), expanding_features=_kind("expanding"),
    ewm_features=_kind("ewm"), window_table=window_table, fill_dates=fill_dates,
)

_KEYS = "CAST(agency AS BIGINT) AS agency, product, CAST(date AS VARCHAR) AS date"
_PART = "PARTITION BY agency, product ORDER BY date"


def _sql_window(kind: str, lag: int, width: int) -> str:
    if kind == "rolling":
        frame = f"({_PART} ROWS BETWEEN {lag + width - 1} PRECEDING AND {lag} PRECEDING)"
        full = f"= {width}"
    else:
        frame = f"({_PART} ROWS BETWEEN UNBOUNDED PRECEDING AND {lag} PRECEDING)"
        full = f">= {width}"
    mean = f"CASE WHEN count(units) OVER {frame} {full} THEN avg(units) OVER {frame} END"
    return f"{mean} AS units_{kind}_l{lag}_w{width}"


def _sql_ewm(lags, widths) -> str:
    """All earlier rows weighted by power(1 - alpha, distance); power(0, 0) is 1."""
    cells = []
    for lag in lags:
        for w in widths:
            keep = f"(1 - 2.0::DOUBLE / {w + 1})"
            weight = f"power({keep}, a.rn - b.rn - {lag})"
            hit = f"FILTER (WHERE b.rn <= a.rn - {lag})"
            cells.append(
                f"round(sum({weight} * b.units) {hit} / sum({weight}) {hit}, 4) AS units_ewm_l{lag}_w{w}"
            )
    return f"""
numbered AS (SELECT *, row_number() OVER ({_PART}) AS rn FROM sales),
ewm AS (SELECT a.agency, a.product, a.date, {", ".join(cells)}
        FROM numbered a LEFT JOIN numbered b
          ON a.agency = b.agency AND a.product = b.product AND b.rn < a.rn
        GROUP BY ALL)"""


_KINDS_SQL = {
    kind: ", ".join(_sql_window(kind, n, w) for n in _LAGS for w in _WIDTHS)
    for kind in ["rolling", "expanding"]
}

ORACLE.update(
    lag_features=f"""
WITH {SALES}
SELECT {_KEYS}, {", ".join(f"round(lag({v}, {n}) OVER ({_PART}), 2) AS {v}_lag_l{n}"
                           for v in ["units", "price"] for n in _LAGS)} FROM sales""",
    rolling_features=f"WITH {SALES} SELECT {_KEYS}, {_KINDS_SQL['rolling']} FROM sales",
    expanding_features=f"WITH {SALES} SELECT {_KEYS}, {_KINDS_SQL['expanding']} FROM sales",
    ewm_features=f"""
WITH {SALES}, {_sql_ewm(_LAGS, _WIDTHS)}
SELECT {_KEYS}, {", ".join(f"units_ewm_l{n}_w{w}" for n in _LAGS for w in _WIDTHS)} FROM ewm""",
    window_table=f"""
WITH {SALES}, {_sql_ewm(_LAGS, [2])},
windows AS (SELECT agency, product, date, price,
            {", ".join(_sql_window(k, n, 2) for k in ["rolling", "expanding"] for n in _LAGS)} FROM sales)
SELECT {_KEYS}, round(price, 4) AS price, * EXCLUDE (agency, product, date, price)
FROM windows JOIN ewm USING (agency, product, date)
WHERE {" AND ".join(f"units_{k}_l{n}_w2 IS NOT NULL" for k in ["ewm", "rolling", "expanding"] for n in _LAGS)}""",
    fill_dates=f"""
WITH {SALES},
known AS (SELECT agency, date, sum(units) AS units FROM sales GROUP BY ALL),
days AS (SELECT agency, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
         FROM sales GROUP BY agency)
SELECT CAST(agency AS BIGINT) AS agency, CAST(date AS VARCHAR) AS date, round(coalesce(units, 0), 2) AS units
FROM days LEFT JOIN known USING (agency, date)""",
)
