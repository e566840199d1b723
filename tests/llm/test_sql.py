"""Registered queries of the text operators against their SQL on the smallest tables."""

import duckdb
import pytest
from featurelab.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    cursor = con.execute(queries.ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted(str(row) for row in cursor.fetchall())
    assert sorted(str(tuple(row[c] for c in columns)) for row in df.collect()) == expected


def test_wrapped_tags_match_sql(spark, tmp_path):
    pages = [
        (1, "http://blocked.net/a", "<p>nothing</p>"),
        (2, "http://free.org/b", '<link\nhref="http://blocked.net/a"\nrel="canonical">'),
        (3, "http://free.org/c", "<META\r\n content='0; URL=http://free.org/b'\r\n http-equiv=refresh>"),
        (4, "http://free.org/d", '<link rel="stylesheet"\nhref="http://blocked.net/a">'),
        (5, None, None), (6, "http://free.org/e", ""),
    ]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    df = queries.QUERIES["op5_url_filters"](spark, str(tmp_path))
    cursor = con.execute(queries.ORACLE["op5_url_filters"])
    columns = [d[0] for d in cursor.description]
    got = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    assert got == sorted(str(row) for row in cursor.fetchall())
    verdicts = {r["page_id"]: r["verdict"] for r in df.collect()}
    assert verdicts == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow"}
