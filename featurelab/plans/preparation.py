"""Sources, projections, filters and row operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from featurelab.functions.draws import integer, uniform
from featurelab.functions.names import clean_columns, clean_values
from featurelab.operators import clean, folds
from featurelab.plans.fixtures import (
    ORDER_FACTS, SALES, account, order_facts, rounded, sales, sql_draw, sql_hash, sql_int,
)
from featurelab.sources import tables
from featurelab.sources.work import new_path

QUERIES, ORACLE = {}, {}


def csv_scan(spark, sf):
    customers = tables.read_table(spark, sf, "customer")
    path = new_path(spark, "csv")
    tables.write_csv(customers, path)
    return tables.read_csv(spark, path, customers.schema)


def csv_scan_inferred(spark, sf):
    orders = tables.read_table(spark, sf, "orders").withColumn("o_orderdate", F.to_date("o_orderdate"))
    path = new_path(spark, "csv")
    tables.write_csv(orders, path)
    return tables.read_csv(spark, path).select(
        F.col("o_orderkey").cast("bigint").alias("o_orderkey"),
        "o_orderstatus",
        "o_totalprice",
        F.col("o_orderdate").cast("string").alias("o_orderdate"),
        "o_orderpriority",
    )


def solutions_restore(spark, sf):
    solutions = account(spark, sf).select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    path = new_path(spark, "solutions")
    tables.save_solutions(solutions, path)
    return tables.load_solutions(spark, path)


def projection(spark, sf):
    return clean.project(tables.read_table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey", "l_quantity"])


def drop_columns(spark, sf):
    return clean.discard(tables.read_table(spark, sf, "customer"), ["c_name", "c_mktsegment"])


def id_prefix(spark, sf):
    lines = tables.read_table(spark, sf, "lineitem")
    return lines.select(
        "l_orderkey",
        clean.prefixed("l_partkey", "producto_").alias("product"),
        clean.prefixed("l_suppkey", "agencia_").alias("agency"),
    )


def date_parse(spark, sf):
    orders = tables.read_table(spark, sf, "orders")
    text = orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    parsed = text.withColumn("day", clean.parse_date("day"))
    return parsed.select("o_orderkey", F.datediff("day", F.lit("1970-01-01")).cast("bigint").alias("days"))


def month_year(spark, sf):
    orders = tables.read_table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    parts = clean.calendar_parts(orders, "d")
    return parts.select("o_orderkey", F.col("month").cast("bigint"), F.col("year").cast("bigint"))


def complete_rows(spark, sf):
    documents = tables.read_table(spark, sf, "documents").select("doc_id", "lang")
    labels = tables.read_table(spark, sf, "labels")
    return clean.complete_rows(documents.join(labels, "doc_id", "left")).select(
        "doc_id", "lang", F.col("quality").cast("bigint"), F.col("toxic").cast("bigint")
    )


def membership(spark, sf):
    lines = tables.read_table(spark, sf, "lineitem")
    parts = tables.read_table(spark, sf, "part").filter(F.col("p_size") > 40)
    keys = parts.select(F.col("p_partkey").alias("l_partkey"))
    found = clean.members(lines, keys, ["l_partkey"]).filter(F.col("l_returnflag") == "R")
    return found.select("l_orderkey", "l_partkey", "l_quantity")


def non_membership(spark, sf):
    lines = tables.read_table(spark, sf, "lineitem")
    parts = tables.read_table(spark, sf, "part").filter(F.col("p_size") > 40)
    keys = parts.select(F.col("p_partkey").alias("l_partkey"))
    found = clean.non_members(lines, keys, ["l_partkey"]).filter(F.col("l_quantity") > 45)
    return found.select("l_orderkey", "l_partkey", "l_quantity")


def negative_clamp(spark, sf):
    return account(spark, sf).select("c_custkey", clean.clamp_negative(F.col("c_acctbal")).alias("balance"))


def column_names(spark, sf):
    dirty = account(spark, sf).select(
        "c_custkey",
        F.col("c_acctbal").alias("acct bal (usd)"),
        F.col("c_mktsegment").alias("mkt.segment/[name]"),
        F.col("c_nationkey").cast("bigint").alias("nation=key?"),
    )
    return clean_columns(dirty)


def value_names(spark, sf):
    orders = tables.read_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return clean_values(orders)


def derived_category(spark, sf):
    return account(spark, sf).select(
        "c_custkey", clean.labelled(F.col("c_nationkey"), 2, "tipo2", "tipo1").alias("kind")
    )


def train_test(spark, sf):
    orders = tables.read_table(spark, sf, "orders").select("o_orderkey")
    return folds.train_test_split(orders, "o_orderkey")


def key_join(spark, sf):
    base = sales(spark, sf)
    feature = base.select("agency", "product", "date", (F.round("price", 2) / F.col("units")).alias("unit_price"))
    joined = clean.aligned_join(base, feature, ["agency", "product", "date"])
    return joined.select(
        F.col("agency").cast("bigint"), "product", F.col("date").cast("string"),
        rounded("units", 2).alias("units"), "unit_price",
    )


def row_join(spark, sf):
    facts = order_facts(spark, sf)
    left = facts.select("row_id", "qty", "n")
    right = facts.select("row_id", "z1", "z2")
    joined = clean.aligned_join(left, right, ["row_id"])
    return joined.select("row_id", "qty", "n", rounded("z1", 8).alias("z1"), rounded("z2", 8).alias("z2"))


def row_union(spark, sf):
    data = account(spark, sf).select("c_custkey", "c_acctbal")
    good, bad = data.filter(F.col("c_acctbal") >= 0), data.filter(F.col("c_acctbal") < 0)
    return clean.stack_rows(
        good.withColumn("part", F.lit("good")), bad.withColumn("part", F.lit("bad"))
    )


def distinct_rows(spark, sf):
    documents = tables.read_table(spark, sf, "documents").select("text", "lang", "source")
    rows = clean.distinct_rows(documents)
    return rows.select("lang", "source", F.md5("text").alias("text_md5"))


def portable_draws(spark, sf):
    orders = tables.read_table(spark, sf, "orders")
    key = F.col("o_orderkey")
    return orders.select(
        "o_orderkey", uniform(key, "u").alias("u"), integer(1000, key, F.col("o_orderstatus")).alias("i")
    )


QUERIES.update(
    csv_scan=csv_scan, csv_scan_inferred=csv_scan_inferred, solutions_restore=solutions_restore,
    projection=projection, drop_columns=drop_columns, id_prefix=id_prefix, date_parse=date_parse,
    month_year=month_year, complete_rows=complete_rows, membership=membership,
    non_membership=non_membership, negative_clamp=negative_clamp, column_names=column_names,
    value_names=value_names, derived_category=derived_category, train_test=train_test,
    key_join=key_join, row_join=row_join, row_union=row_union, distinct_rows=distinct_rows,
    portable_draws=portable_draws,
)

_CLEAN_PRIORITY = "o_orderpriority"
for _sign in [" ", ".", "/", "(", ")", "-", "%", "''", "[", "]", "{", "}", "=", "?", "__"]:
    _CLEAN_PRIORITY = f"replace({_CLEAN_PRIORITY}, '{_sign}', '_')"

ORACLE.update(
    csv_scan="SELECT * FROM customer",
    csv_scan_inferred="""
SELECT o_orderkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
       o_orderpriority FROM orders""",
    solutions_restore="SELECT c_custkey AS id, c_acctbal AS score FROM customer",
    projection="SELECT l_orderkey, l_partkey, l_quantity FROM lineitem",
    drop_columns="SELECT c_custkey, c_nationkey, c_acctbal FROM customer",
    id_prefix="""
SELECT l_orderkey, 'producto_' || l_partkey AS product, 'agencia_' || l_suppkey AS agency FROM lineitem""",
    date_parse="""
SELECT o_orderkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS days FROM orders""",
    month_year="""
SELECT o_orderkey, month(o_orderdate) AS month, year(o_orderdate) AS year FROM orders""",
    complete_rows="""
SELECT doc_id, lang, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic
FROM documents JOIN labels USING (doc_id)
WHERE lang IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL""",
    membership="""
SELECT l_orderkey, l_partkey, l_quantity FROM lineitem
WHERE l_returnflag = 'R' AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40)""",
    non_membership="""
SELECT l_orderkey, l_partkey, l_quantity FROM lineitem
WHERE l_quantity > 45 AND NOT EXISTS (SELECT 1 FROM part WHERE p_size > 40 AND p_partkey = l_partkey)""",
    negative_clamp="""
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS balance FROM customer""",
    column_names="""
SELECT c_custkey, c_acctbal AS acct_bal_usd_, c_mktsegment AS mkt_segment_name_,
       CAST(c_nationkey AS BIGINT) AS nation_key_ FROM customer""",
    value_names=f"SELECT o_orderkey, {_CLEAN_PRIORITY} AS o_orderpriority FROM orders",
    derived_category="""
SELECT c_custkey, CASE WHEN c_nationkey = 2 THEN 'tipo2' ELSE 'tipo1' END AS kind FROM customer""",
    train_test=f"""
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {sql_hash("o_orderkey", "'split'")}, o_orderkey) AS rn,
                  count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN rn <= ceil(n * 0.33) THEN 'test' ELSE 'train' END AS part FROM r""",
    key_join=f"""
WITH {SALES}
SELECT CAST(b.agency AS BIGINT) AS agency, b.product, CAST(b.date AS VARCHAR) AS date,
       round(b.units, 2) AS units, round(f.price, 2) / f.units AS unit_price
FROM sales b JOIN sales f ON b.agency = f.agency AND b.product = f.product AND b.date = f.date""",
    row_join=f"""
WITH {ORDER_FACTS}
SELECT l.row_id, l.qty, l.n, round(r.z1, 8) AS z1, round(r.z2, 8) AS z2
FROM facts l JOIN facts r ON l.row_id = r.row_id""",
    row_union="""
SELECT c_custkey, c_acctbal, 'good' AS part FROM customer WHERE c_acctbal >= 0
UNION ALL SELECT c_custkey, c_acctbal, 'bad' FROM customer WHERE c_acctbal < 0""",
    distinct_rows="""
SELECT lang, source, md5(text) AS text_md5 FROM (SELECT DISTINCT text, lang, source FROM documents)""",
    portable_draws=f"""
SELECT o_orderkey, {sql_draw("o_orderkey", "'u'")} AS u,
       {sql_int("1000", "o_orderkey", "o_orderstatus")} AS i FROM orders""",
)
