"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, canonical

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


def test_names_match():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def has_no_cross_join(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_equals_sql(spark, con, name):
    df = contract.queries()[name](spark, FOLDER)
    rows = df.collect()
    assert has_no_cross_join(df)
    cursor = con.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(df.columns, rows) == canonical(columns, cursor.fetchall())
    assert rows or name == "unscored_genomes"


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_gives_rows(spark, name):
    df = contract.queries()[name](spark, FOLDER)
    assert df.count() > 0 and has_no_cross_join(df)


def test_entry(spark):
    df = contract.entry(spark)
    assert {"run_id", "idx", "genome", "score", "features"} == set(df.columns)
    assert df.count() > 0
