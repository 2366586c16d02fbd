import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from vitalscope.operators import corpus, sampling, wide


def test_block_of_any_table(spark):
    rows = [(1, 2.0, "b", "x"), (2, None, "a", None), (3, 6.0, "b", "y"), (4, float("nan"), "c", "x")]
    df = spark.createDataFrame(rows, "id int, n double, kind string, other string").repartition(3)
    s = wide.generic_structured(df, exclude=("id",))
    assert (s.numeric, s.categorical, s.size) == (["n"], ["kind", "other"], 1 + 3 + 3)
    got = {r["id"]: r["v"] for r in s.add_block(df, "f").select("id", vector_to_array("f").alias("v")).collect()}
    filled = np.array([2.0, 4.0, 6.0, 4.0])
    assert np.allclose([got[i][0] for i in (1, 2, 3, 4)], (filled - 4) / filled.std())
    # a b c, then MISSING x y
    assert [got[i][1:] for i in (1, 2, 3, 4)] == [[0, 1, 0, 0, 1, 0], [1, 0, 0, 1, 0, 0], [0, 1, 0, 0, 0, 1], [0, 0, 1, 0, 1, 0]]
    new = spark.createDataFrame([(9, 1.0, "zzz", "y")], df.schema)
    assert s.add_block(new, "f").select(F.slice(vector_to_array("f"), 2, 6).alias("v")).first()["v"] == [0, 0, 0, 0, 0, 1]
    assert s.add_codes(new).first()["kind_code"] is None


def test_a_million_categories(spark):
    n = 1_000_000
    df = spark.range(n).select("id", F.format_string("value %07d", F.col("id")).alias("name"), F.lit("hot").alias("same"))
    s = wide.WideStructured.fit(df, ["id"], ["name", "same"])
    assert s.size == 1 + n + 1
    some = s.add_block(df.filter("id % 99991 = 0"), "f").select("id", "f").collect()
    assert all(r["f"].size == n + 2 and list(r["f"].indices)[-2:] == [1 + r["id"], n + 1] for r in some) and len(some) == 11
    # Values of a column are sorted in ranges: codes come without one task that holds them all.
    per_task = s.codes.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert max(per_task) < n


def test_usable_rows(spark):
    rows = [(1, " a ", "x"), (2, "", "x"), (3, None, "x"), (4, "\u00a0\t", "x"), (5, "b", None), (6, "b", "c\n")]
    df = spark.createDataFrame(rows, "id int, text string, dept string")
    assert [tuple(r) for r in corpus.usable_rows(df, ["text", "dept"]).orderBy("id").collect()] == [(1, "a", "x"), (6, "b", "c")]
    assert corpus.usable_rows(df.limit(0), ["text"]).count() == 0


def test_samples_per_group_rank_only_what_tasks_keep(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") < 4500, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g")).repartition(6)
    got = sampling.sample_per_group(df, "id", "g", 7)
    want = sampling.ranked(df, "id", "g", 42, "_rank").filter("_rank <= 7")
    assert {r["id"] for r in got.collect()} == {r["id"] for r in want.collect()}
    plan = sampling.sample_per_group(df, "id", "g", 7)._jdf.queryExecution().executedPlan().toString()
    # Read from the bottom: tasks cut their rows before the exchange, and the window comes after it.
    places = [plan.index(x) for x in ("Window [", ", 7, Final", "Exchange hashpartitioning(g", ", 7, Partial")]
    assert places == sorted(places)
    assert sampling.sample_per_group(df, "id", "g", 1200).count() == 1200 + 500
