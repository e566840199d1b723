"""Dummies, folds and feature vectors."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from featurelab.operators import encode, folds
from featurelab.plans.fixtures import ORDER_FACTS, ORDER_FEATURES, folded, order_facts, rounded, sql_hash
from featurelab.plans.profiling import sql_folds
from featurelab.sources.tables import read_table

QUERIES, ORACLE = {}, {}


def _segments(spark, sf):
    return read_table(spark, sf, "customer").select("c_custkey", "c_mktsegment")


def dummies(spark, sf):
    return encode.dummies(_segments(spark, sf), ["c_mktsegment"])


def encoded_table(spark, sf):
    orders = read_table(spark, sf, "orders")
    code = F.split_part("o_orderpriority", F.lit("-"), F.lit(1))
    table = orders.select("o_orderkey", "o_totalprice", "o_orderstatus", code.alias("code"))
    return encode.encode_table(table)


def dummy_vector(spark, sf):
    """One sparse vector per document, summed back to a count per category slot."""
    documents = read_table(spark, sf, "documents").select("doc_id", "lang", "source")
    coded = encode.dummy_vector(documents, ["lang", "source"], "flags")
    slots = coded.select(F.posexplode(vector_to_array("flags")).alias("slot", "flag"))
    return slots.groupBy(F.col("slot").cast("bigint")).agg(F.sum("flag").cast("bigint").alias("rows"))


def category_slots(spark, sf):
    """Slots of the customers' names and segments: as many categories as rows, and a few."""
    customers = read_table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    coded, size = encode.dummy_slots(customers, ["c_name", "c_mktsegment"], "slots")
    return coded.select(
        "c_custkey", F.col("slots")[0].alias("name_slot"), F.col("slots")[1].alias("segment_slot"),
        F.lit(size).cast("bigint").alias("slots"),
    )


def random_folds(spark, sf):
    orders = read_table(spark, sf, "orders").select("o_orderkey")
    return folds.random_folds(orders, "o_orderkey", 7).withColumn("fold", F.col("fold").cast("bigint"))


def group_folds(spark, sf):
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return folds.group_folds(orders, "o_custkey", 5).withColumn("fold", F.col("fold").cast("bigint"))


def balanced_group_folds(spark, sf):
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    dealt = folds.group_folds(orders, "o_custkey", 5, balance="rows")
    return dealt.select("o_orderkey", "o_custkey", F.col("fold").cast("bigint"))


def fold_views(spark, sf):
    """Rows and feature sums of the train and the test side of every fold."""
    data = folded(order_facts(spark, sf))
    sides = None
    for k in range(3):
        for part, rows in [("train", folds.train_rows(data, k)), ("test", folds.test_rows(data, k))]:
            one = rows.drop("y").agg(
                F.lit(k).cast("bigint").alias("fold"), F.lit(part).alias("part"),
                F.count(F.lit(1)).alias("rows"), rounded(F.sum("qty"), 2).alias("qty"),
            )
            sides = one if sides is None else sides.unionByName(one)
    return sides


def masked_vector(spark, sf):
    vectors = encode.feature_vector(order_facts(spark, sf), ORDER_FEATURES)
    masked = encode.masked_vector(vectors, "011000000")
    parts = vector_to_array("masked")
    return masked.select("row_id", parts[0].alias("first"), rounded(parts[1], 6).alias("second"))


QUERIES.update(
    dummies=dummies, encoded_table=encoded_table, dummy_vector=dummy_vector, category_slots=category_slots, random_folds=random_folds,
    group_folds=group_folds, balanced_group_folds=balanced_group_folds, fold_views=fold_views,
    masked_vector=masked_vector,
)

_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

ORACLE.update(
    category_slots="""
WITH n AS (SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS i FROM (SELECT DISTINCT c_name FROM customer WHERE c_name IS NOT NULL)),
s AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS i
      FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL)),
t AS (SELECT (SELECT count(*) FROM n) AS names, (SELECT count(*) FROM s) AS segments)
SELECT c_custkey, coalesce(n.i, names) AS name_slot, names + 1 + coalesce(s.i, segments) AS segment_slot, names + segments + 2 AS slots
FROM customer LEFT JOIN n USING (c_name) LEFT JOIN s USING (c_mktsegment), t""",
    dummies=f"""
SELECT c_custkey, {", ".join(f'''CAST(coalesce(c_mktsegment = '{s}', false) AS BIGINT) AS "{s}"''' for s in _SEGMENTS)}
FROM customer""",
    encoded_table="""
SELECT o_orderkey, o_totalprice, CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE) AS code,
       CAST(o_orderstatus = 'F' AS BIGINT) AS "F", CAST(o_orderstatus = 'O' AS BIGINT) AS "O",
       CAST(o_orderstatus = 'P' AS BIGINT) AS "P" FROM orders""",
    random_folds=f"SELECT o_orderkey, fold FROM ({sql_folds('orders', 'o_orderkey', 7)})",
    group_folds=f"""
WITH g AS (SELECT o_custkey, row_number() OVER (ORDER BY {sql_hash("o_custkey", "'fold'")}, o_custkey) - 1 AS place,
                  count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders)),
cuts AS (SELECT k, n * k // 5 AS start FROM (SELECT DISTINCT n FROM g), range(1, 5) t(k))
SELECT o_orderkey, o_custkey, (SELECT count(*) FROM cuts WHERE start <= g.place) AS fold
FROM orders JOIN g USING (o_custkey)""",
    balanced_group_folds=f"""
WITH g AS (SELECT o_custkey, row_number() OVER (ORDER BY n DESC, {sql_hash("o_custkey", "'fold'")}, o_custkey) - 1 AS place
           FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1))
SELECT o_orderkey, o_custkey,
       CAST(CASE WHEN (place // 5) % 2 = 0 THEN place % 5 ELSE 4 - place % 5 END AS BIGINT) AS fold
FROM orders JOIN g USING (o_custkey)""",
    fold_views=f"""
WITH {ORDER_FACTS}, b AS ({sql_folds("facts", "row_id", 3)})
SELECT k AS fold, part, count(*) AS rows, round(sum(qty), 2) AS qty
FROM b, range(0, 3) t(k), (VALUES ('train'), ('test')) p(part)
WHERE (part = 'test') = (b.fold = k) GROUP BY ALL""",
    masked_vector=f"WITH {ORDER_FACTS} SELECT row_id, qty AS first, round(price, 6) AS second FROM facts",
    dummy_vector="""
WITH l AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS i, count(*) OVER () AS n
           FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)),
s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS n
      FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)),
hits AS (SELECT coalesce(l.i, (SELECT any_value(n) FROM l)) AS slot FROM documents LEFT JOIN l USING (lang)
         UNION ALL
         SELECT (SELECT any_value(n) FROM l) + 1 + coalesce(s.i, (SELECT any_value(n) FROM s))
         FROM documents LEFT JOIN s USING (source)),
slots AS (SELECT unnest(range(0, (SELECT any_value(n) FROM l) + (SELECT any_value(n) FROM s) + 2)) AS slot)
SELECT slots.slot, count(hits.slot) AS rows FROM slots LEFT JOIN hits ON slots.slot = hits.slot GROUP BY 1""",
)
