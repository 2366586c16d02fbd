"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.compare import rows_of

SQL = oracle_sql()
QUERIES = queries()
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@pytest.fixture(scope="module")
def con():
    return duckdb.connect()


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark, folder):
    assert entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, folder, con, name):
    for table in TABLES:
        con.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = QUERIES[name](spark, folder)
    result = con.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert rows_of(df.columns, df.collect()) == rows_of(names, result.fetchall())
