"""The registered queries against their SQL, and the pipeline's contract."""

import duckdb
import pytest

import corpus_pipeline
from tools.compare import rows_of
from vitalscope.llm import queries

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 1 + len(queries.QUERIES))]
    assert set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, folder, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df, result = queries.QUERIES[name](spark, folder), con.execute(queries.SQL[name])
    names = [d[0] for d in result.description]
    assert rows_of(df.columns, df.collect()) == rows_of(names, result.fetchall())


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before, columns = {r["doc_id"] for r in docs.select("doc_id").collect()}, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, folder))
        assert docs.columns == columns, name
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert set(ids) <= before and len(ids) == len(set(ids))
        before = set(ids)
    got = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in got.select("doc_id").collect()} == before
