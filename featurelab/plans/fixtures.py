"""Inputs the registered queries share, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurelab.functions.draws import uniform
from featurelab.functions.genes import random_genome
from featurelab.operators import folds
from featurelab.sources.tables import read_table
from featurelab.sources.work import materialize

# Individuals per run of the genome fixture, as in the feature search's settings.
RUN_SIZE = 50
GENES = 15


def rounded(column, digits: int = 4):
    """Rounded for comparison; adding 0.0 turns -0.0 into 0.0."""
    return F.round(column, digits) + F.lit(0.0)


def sql_hash(*keys: str, seed: int = 42) -> str:
    text = ", ".join(["'|'", f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"CAST('0x' || substr(md5(concat_ws({text})), 1, 8) AS BIGINT)"


def sql_draw(*keys: str, seed: int = 42) -> str:
    return f"({sql_hash(*keys, seed=seed)} / 4294967296.0)"


def sql_int(n: str, *keys: str, seed: int = 42) -> str:
    return f"CAST(floor({sql_draw(*keys, seed=seed)} * ({n})) AS BIGINT)"


def sql_digest(*keys: str, seed: int = 42) -> str:
    text = ", ".join(["'|'", f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"md5(concat_ws({text}))"


def sql_bits(digest: str) -> str:
    return f"translate({digest}, '0123456789abcdef', '0000000011111111')"


def sales(spark: SparkSession, sf: str) -> DataFrame:
    """Units and price summed by agency, product and day."""
    lines = read_table(spark, sf, "lineitem")
    parts = read_table(spark, sf, "part").select("p_partkey", "p_brand")
    suppliers = read_table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(
            F.col("s_nationkey").alias("agency"),
            F.col("p_brand").alias("product"),
            F.to_date("l_shipdate").alias("date"),
        )
        .agg(F.sum("l_quantity").alias("units"), F.sum("l_extendedprice").alias("price"))
    )


SALES = """
sales AS (
  SELECT s_nationkey AS agency, p_brand AS product, CAST(l_shipdate AS DATE) AS date,
         sum(l_quantity) AS units, sum(l_extendedprice) AS price
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY ALL)"""


def account(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "customer").select(
        "c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey"
    )


ORDER_FEATURES = ["n", "qty", "price", "disc", "tax", "z1", "z2", "z3", "z4"]


def order_facts(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order: five real features, four noise features and the target ``y``."""
    lines = read_table(spark, sf, "lineitem")
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return lines.groupBy(F.col("l_orderkey").alias("row_id")).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum("l_quantity").alias("qty"),
        (F.sum("l_extendedprice") / 1000).alias("price"),
        F.avg("l_discount").alias("disc"),
        F.avg("l_tax").alias("tax"),
        (F.sum(revenue) / 1000).alias("y"),
    ).withColumns({f"z{i}": uniform(F.col("row_id"), i) for i in range(1, 5)})


ORDER_FACTS = f"""
facts AS (
  SELECT l_orderkey AS row_id, CAST(count(*) AS DOUBLE) AS n, sum(l_quantity) AS qty,
         sum(l_extendedprice) / 1000 AS price, avg(l_discount) AS disc, avg(l_tax) AS tax,
         sum(l_extendedprice * (1 - l_discount)) / 1000 AS y,
         {", ".join(f"{sql_draw('l_orderkey', str(i))} AS z{i}" for i in range(1, 5))}
  FROM lineitem GROUP BY l_orderkey)"""



def folded(df: DataFrame, k: int = 3) -> DataFrame:
    """The facts written once with their fold draw, and their folds."""
    written = materialize(df.withColumn("draw", folds.fold_draw("row_id")), "facts")
    return folds.random_folds(written, "row_id", k, draw="draw")


LABEL_ABOVE = 100.0


def order_classes(spark: SparkSession, sf: str) -> DataFrame:
    facts = order_facts(spark, sf)
    return facts.withColumn("label", (F.col("y") > LABEL_ABOVE).cast("int"))


ORDER_CLASSES = ORDER_FACTS + """,
classes AS (SELECT *, CAST(y > 100 AS INT) AS label FROM facts)"""


def genomes(spark: SparkSession, sf: str) -> DataFrame:
    """Populations of at most 50 genomes: customer keys are unique, so a run cannot grow."""
    key = F.col("c_custkey")
    return read_table(spark, sf, "customer").select(
        F.floor(key / RUN_SIZE).cast("bigint").alias("run_id"),
        (key % RUN_SIZE).cast("bigint").alias("idx"),
        random_genome(GENES, key).alias("genome"),
    )


GENOMES = f"""
genomes AS (
  SELECT c_custkey // {RUN_SIZE} AS run_id, c_custkey % {RUN_SIZE} AS idx,
         substr({sql_bits(sql_digest("c_custkey"))}, 1, {GENES}) AS genome
  FROM customer)"""

LAYERS, NEURONS = 4, 4
# The model names of the stacked grid, in registry order.
MODEL_NAMES = [
    "lgbm", "adaboost", "extratrees", "xgboost", "bagging", "bayesridge", "elasticnet",
    "randomforest", "gradientboosting", "multinomial", "gaussiannb", "linear",
]


def systems(spark: SparkSession, sf: str) -> DataFrame:
    """One model grid per supplier."""
    return read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("system_id"))
