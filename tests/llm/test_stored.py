"""A stored table leaves no shuffle files behind, and tasks are sent no tables that they make themselves."""

import time

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from vitalscope.llm import common, ngram_join


def _shuffle_files(spark):
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    blocks = env.blockManager().diskBlockManager().getAllBlocks().mkString(",")
    return {b for b in blocks.split(",") if b.startswith("shuffle_")}


def test_stored_removes_its_shuffle_files(spark):
    before, setting = _shuffle_files(spark), spark.conf.get(common.CLEANUP, None)
    rows = spark.range(1000, numPartitions=3).withColumn("k", F.col("id") % 7)
    got = common.stored(rows.groupBy("k").agg(F.count("*").alias("n")))
    assert {tuple(r) for r in got.collect()} == {(k, 143 if k < 6 else 142) for k in range(7)}
    for _ in range(20):
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before
    assert spark.conf.get(common.CLEANUP, None) == setting


def test_functions_travel_without_the_drivers_powers():
    texts = pa.array(["one two three four"])
    before = common.Words(texts).hashes().tolist()
    sent = cloudpickle.dumps(common.released(ngram_join._signed(3)))
    assert len(sent) < 1 << 20
    batch = pa.RecordBatch.from_arrays([pa.array([7]), texts], ["doc_id", "text"])
    (got,) = cloudpickle.loads(sent)(iter([batch]))
    assert got.column(1).to_pylist() == [2] and common.Words(texts).hashes().tolist() == before
