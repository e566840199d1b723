"""Aggregation and profiling reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from featurelab.operators import folds, profile
from featurelab.operators.clean import clamp_negative
from featurelab.plans.fixtures import SALES, account, rounded, sales, sql_hash
from featurelab.sources.tables import read_table

QUERIES, ORACLE = {}, {}

_LINE_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]
_LIKE_THRESHOLD = 1.5


def group_sum(spark, sf):
    summed = sales(spark, sf)
    return summed.select(
        F.col("agency").cast("bigint"), "product", F.col("date").cast("string"),
        rounded("units", 2).alias("units"), rounded("price", 2).alias("price"),
    )


def column_classes(spark, sf):
    orders = read_table(spark, sf, "orders")
    part = F.split_part("o_orderpriority", F.lit("-"), F.lit(1))
    return profile.classify_columns(orders.withColumn("priority_code", part))


def numeric_describe(spark, sf):
    report = profile.describe_numeric(read_table(spark, sf, "lineitem"), _LINE_NUMBERS)
    numbers = [c for c in report.columns if c not in ("column", "count")]
    return report.select("column", "count", *[rounded(c).alias(c) for c in numbers])


def string_describe(spark, sf):
    return profile.describe_strings(read_table(spark, sf, "documents")).drop("top_count")


def category_counts(spark, sf):
    parts = read_table(spark, sf, "part").select("p_brand", "p_type", "p_name")
    return profile.category_counts(parts)


def rare_categories(spark, sf):
    parts = read_table(spark, sf, "part").select("p_brand", "p_type", "p_name")
    return profile.rare_categories(parts).withColumn("length_pct", rounded("length_pct", 6))


def outlier_counts(spark, sf):
    lines = read_table(spark, sf, "lineitem")
    counts = profile.outlier_counts(lines, _LINE_NUMBERS)
    return counts.withColumn("threshold", rounded("threshold"))


def rare_folding(spark, sf):
    parts = read_table(spark, sf, "part").select("p_partkey", "p_brand")
    return profile.fold_rare(parts, "p_brand", 0.04)


def z_score(spark, sf):
    scored = profile.z_score(account(spark, sf), ["c_acctbal"])
    return scored.select("c_custkey", rounded("c_acctbal", 6).alias("z"))


def median_mad(spark, sf):
    lines = read_table(spark, sf, "lineitem")
    found = profile.medians_and_mads(lines, _LINE_NUMBERS)
    rows = [(c, *pair) for c, pair in found.items()]
    report = spark.createDataFrame(rows, "column string, median double, mad double")
    return report.select("column", rounded("median").alias("median"), rounded("mad").alias("mad"))


def mad_outliers(spark, sf):
    data = account(spark, sf).withColumn("c_acctbal", clamp_negative(F.col("c_acctbal")))
    median, mad = profile.median_and_mad(data, "c_acctbal")
    flag = profile.mad_outlier(F.col("c_acctbal"), median, mad, _LIKE_THRESHOLD)
    return data.select("c_custkey", flag.cast("bigint").alias("outlier"))


def like_labels(spark, sf):
    labelled = profile.label_likes(account(spark, sf), "c_acctbal", _LIKE_THRESHOLD)
    return labelled.select("c_custkey", "c_acctbal", "like")


def min_max(spark, sf):
    scaled = profile.min_max(account(spark, sf), ["c_acctbal"])
    return scaled.select("c_custkey", rounded("c_acctbal", 6).alias("scaled"))


def _document_folds(spark, sf):
    documents = read_table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    return folds.random_folds(documents, "doc_id", 3)


def fold_copies(spark, sf):
    report = folds.fold_copies(_document_folds(spark, sf), ["text", "lang", "source"], 3)
    return report.select(
        F.col("fold").cast("bigint"), "inside_fold", "other_folds", "all_folds",
        rounded("share", 6).alias("share"),
    )


def fold_means(spark, sf):
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    report = folds.fold_means(folds.random_folds(orders, "o_orderkey", 3), "o_totalprice")
    name = F.coalesce(F.col("fold").cast("string"), F.lit("all_data"))
    return report.select(name.alias("fold"), rounded("mean", 2).alias("mean"), "rows")


QUERIES.update(
    group_sum=group_sum, column_classes=column_classes, numeric_describe=numeric_describe,
    string_describe=string_describe, category_counts=category_counts, rare_categories=rare_categories,
    outlier_counts=outlier_counts, rare_folding=rare_folding, z_score=z_score, median_mad=median_mad,
    mad_outliers=mad_outliers, like_labels=like_labels, min_max=min_max, fold_copies=fold_copies,
    fold_means=fold_means,
)


def sql_folds(table: str, key: str, folds_: int) -> str:
    """Random folds in SQL: ``round_even`` gives the half-even fold size."""
    return f"""
  SELECT * EXCLUDE (rn, total),
         CAST(least((rn - 1) // CAST(round_even(total / {folds_}.0, 0) AS BIGINT), {folds_ - 1}) AS BIGINT) AS fold
  FROM (SELECT *, row_number() OVER (ORDER BY {sql_hash(key, "'fold'")}, {key}) AS rn,
               count(*) OVER () AS total FROM {table})"""


_DESCRIBE = " UNION ALL ".join(
    f"""
SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
       round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q25,
       round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75,
       round(max({c}), 4) AS max FROM lineitem"""
    for c in _LINE_NUMBERS
)
_OUTLIERS = " UNION ALL ".join(
    f"""
SELECT '{c}' AS "column", {k} AS k, round(any_value(m.a + {k} * m.s), 4) AS threshold,
       count(*) FILTER (WHERE {c} >= m.a + {k} * m.s) AS count
FROM lineitem, (SELECT avg({c}) AS a, stddev_samp({c}) AS s FROM lineitem) m"""
    for c in _LINE_NUMBERS
    for k in ["1.0::DOUBLE", "2.0::DOUBLE", "2.5::DOUBLE", "3.0::DOUBLE"]
)
_CATEGORIES = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {c} AS "value", count(*) AS count FROM part WHERE {c} IS NOT NULL GROUP BY 2"""
    for c in ["p_brand", "p_type", "p_name"]
)
_MAD = f"""
d AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS x FROM customer),
m AS (SELECT quantile_cont(x, 0.5) AS med FROM d),
s AS (SELECT quantile_cont(abs(x - med), 0.5) AS mad FROM d, m),
f AS (SELECT c_custkey, x, CASE WHEN mad = 0 THEN x <> med ELSE abs(x - med) / mad > {_LIKE_THRESHOLD} END AS bad
      FROM d, m, s)"""

ORACLE.update(
    group_sum=f"""
WITH {SALES}
SELECT CAST(agency AS BIGINT) AS agency, product, CAST(date AS VARCHAR) AS date,
       round(units, 2) AS units, round(price, 2) AS price FROM sales""",
    column_classes="""
SELECT * FROM (VALUES ('o_orderkey', 1::BIGINT), ('o_custkey', 1), ('o_totalprice', 1)) t("column", is_numeric)
UNION ALL SELECT 'o_orderstatus', CAST(count(o_orderstatus) = count(TRY_CAST(o_orderstatus AS DOUBLE)) AS BIGINT) FROM orders
UNION ALL SELECT 'o_orderpriority', CAST(count(o_orderpriority) = count(TRY_CAST(o_orderpriority AS DOUBLE)) AS BIGINT) FROM orders
UNION ALL SELECT 'o_orderdate', 0
UNION ALL SELECT 'priority_code', CAST(count(p) = count(TRY_CAST(p AS DOUBLE)) AS BIGINT)
          FROM (SELECT split_part(o_orderpriority, '-', 1) AS p FROM orders)""",
    numeric_describe=_DESCRIBE,
    string_describe=" UNION ALL ".join(
        f"""
SELECT '{c}' AS "column", CAST(sum(n) AS BIGINT) AS count, count(*) AS "unique",
       (SELECT {c} FROM documents WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1) AS top
FROM (SELECT {c}, count(*) AS n FROM documents WHERE {c} IS NOT NULL GROUP BY 1)"""
        for c in ["text", "lang", "source"]
    ),
    category_counts=_CATEGORIES,
    rare_categories=f"""
SELECT "column", "value", count AS length, round(count / n, 6) AS length_pct,
       CAST(count / n < 0.05 AS BIGINT) AS rare, CAST(count / n < 0.01 AS BIGINT) AS very_rare
FROM ({_CATEGORIES}), (SELECT count(*) AS n FROM part)""",
    outlier_counts=_OUTLIERS,
    rare_folding="""
WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1),
t AS (SELECT p_brand AS top FROM c ORDER BY n DESC, p_brand LIMIT 1)
SELECT p_partkey, CASE WHEN c.n / (SELECT count(*) FROM part) < 0.04 THEN top ELSE part.p_brand END AS p_brand
FROM part JOIN c USING (p_brand), t""",
    z_score="""
SELECT c_custkey, round((c_acctbal - m) / s, 6) + 0.0 AS z
FROM customer, (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer)""",
    median_mad=" UNION ALL ".join(
        f"""
SELECT '{c}' AS "column", round(any_value(m), 4) AS median, round(quantile_cont(abs({c} - m), 0.5), 4) AS mad
FROM lineitem, (SELECT quantile_cont({c}, 0.5) AS m FROM lineitem)"""
        for c in _LINE_NUMBERS
    ),
    mad_outliers=f"WITH {_MAD} SELECT c_custkey, CAST(bad AS BIGINT) AS outlier FROM f",
    like_labels=f"""
WITH {_MAD},
g AS (SELECT min(x) AS low, max(x) AS high, avg(x) AS mean FROM f WHERE NOT bad)
SELECT c_custkey, x AS c_acctbal,
       CAST(CASE WHEN bad THEN CASE WHEN x > low THEN 2 ELSE 0 END
                 WHEN x > mean AND high > low THEN 1 ELSE 0 END AS BIGINT) AS "like"
FROM f, g""",
    min_max="""
SELECT c_custkey, round((c_acctbal - lo) / (hi - lo), 6) AS scaled
FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)""",
    fold_copies=f"""
WITH b AS ({sql_folds("documents", "doc_id", 3)}),
k AS (SELECT DISTINCT fold FROM b),
c AS (SELECT k.fold,
        (SELECT count(*) FROM b) AS n_all,
        (SELECT count(*) FROM (SELECT DISTINCT text, lang, source FROM b)) AS d_all,
        (SELECT count(*) FROM b WHERE b.fold = k.fold) AS n_in,
        (SELECT count(DISTINCT (text, lang, source)) FROM b WHERE b.fold = k.fold) AS d_in,
        (SELECT count(*) FROM b WHERE b.fold <> k.fold) AS n_out,
        (SELECT count(DISTINCT (text, lang, source)) FROM b WHERE b.fold <> k.fold) AS d_out FROM k)
SELECT fold, n_in - d_in AS inside_fold, n_out - d_out AS other_folds, n_all - d_all AS all_folds,
       round((n_all - d_all) / n_all, 6) AS share FROM c""",
    fold_means=f"""
WITH b AS ({sql_folds("orders", "o_orderkey", 3)})
SELECT CASE WHEN fold IS NULL THEN 'all_data' ELSE CAST(fold AS VARCHAR) END AS fold,
       round(avg(o_totalprice), 2) AS mean, count(o_totalprice) AS rows
FROM b GROUP BY ROLLUP (b.fold)""",
)
