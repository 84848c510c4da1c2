"""Registered queries against their SQL, and the rows of the others."""

import pytest

from quantmill.llm import queries

from ..compare import close, connect, rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, small_dir, name):
    con = connect(small_dir)
    df = queries.QUERIES[name](spark, small_dir)
    rel = con.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    found, expected = rows(df.columns, df.collect()), rows(rel.columns, rel.fetchall())
    assert len(found) == len(expected) > 0
    assert all(all(map(close, a, b)) for a, b in zip(found, expected, strict=True))


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if n not in queries.ORACLE_SQL and not n.startswith("op2_")))
def test_one_row_for_each_document(spark, small_dir, name):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    out = queries.QUERIES[name](spark, small_dir)
    assert out.count() == docs.count() and out.select("doc_id").distinct().count() == docs.count()
    assert out.schema == queries.QUERIES[name](spark, small_dir).schema
