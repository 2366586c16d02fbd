"""Fixtures and brute-force versions shared by the tests of the corpus operators."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "long words of a very long text " * 4000


def docs_of(spark, rows, clash=True):
    """A table doc_id, text; ``clash`` adds columns named like those the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if clash:
        from pyspark.sql import functions as F

        for name in ("score", "key", "node", "page", "h", "n", "ids", "part", "found", "__id"):
            df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def sorted_rows(rows):
    return sorted((tuple(r) for r in rows), key=repr)
