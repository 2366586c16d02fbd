import pytest
from pyspark.sql import functions as F

from vitalscope.operators import enrich, skew
from vitalscope.streaming import adapters


def service():
    return lambda texts: [None if t == "bad" else t.upper() for t in texts]


def rows(spark):
    # One text makes up most of the rows.
    texts = ["hot"] * 300 + ["a", "b", "bad", "cached", "b"]
    return spark.createDataFrame(list(enumerate(texts)), "id long, t string")


def cache(spark):
    return spark.createDataFrame([("cached", "C"), ("a", "  "), ("a", None)], "t string, v string")


def test_statuses_and_resume(spark):
    out = enrich.enrich(rows(spark), cache(spark), "t", "v", "id", service).cache()
    counts = enrich.status_counts(out).first()
    assert (counts["n_rows"], counts["n_resumed"], counts["n_translated"], counts["n_failed"]) == (305, 1, 303, 1)
    values = {r["t"]: r["v"] for r in out.collect()}
    assert values == {"hot": "HOT", "a": "A", "b": "B", "bad": None, "cached": "C"}
    again = enrich.from_cache(rows(spark), out.select("t", "v"), "t", "v")
    assert [r["t"] for r in enrich.pending_texts(again, "t").collect()] == ["bad"]
    with pytest.raises(ValueError):
        enrich.require_complete(out)
    assert enrich.require_complete(out.filter("t <> 'bad'")).count() == 304


def test_a_batch_that_raises_is_failed_not_fatal(spark):
    def broken():
        def call(texts):
            raise RuntimeError("down")
        return call

    out = enrich.enrich(rows(spark), cache(spark), "t", "v", "id", broken)
    assert enrich.status_counts(out).first()["n_failed"] == 304


def test_cache_path_is_what_a_second_run_reads(spark, tmp_path):
    path = str(tmp_path / "cache")
    first = enrich.enrich(rows(spark), cache(spark), "t", "v", "id", service, cache_path=path)
    assert enrich.status_counts(first).first()["n_translated"] == 303
    second = enrich.from_cache(rows(spark), spark.read.parquet(path), "t", "v")
    assert enrich.status_counts(second).first()["n_resumed"] == 303


def counting(folder, die_on=None):
    """A service that notes every text it is asked for, and may end its worker."""
    def load():
        import os

        def call(texts):
            for t in texts:
                with open(f"{folder}/{t}", "a") as log:
                    log.write("x")
                if t == die_on:
                    os._exit(1)
            return [t.upper() for t in texts]
        return call
    return load


def test_the_service_sees_each_text_once(spark, tmp_path):
    import os

    folder = tmp_path / "calls"
    folder.mkdir()
    out = enrich.enrich(rows(spark), cache(spark), "t", "v", "id", counting(str(folder)))
    assert out.count() == 305 and enrich.status_counts(out).first()["n_translated"] == 304
    assert {f: os.path.getsize(folder / f) for f in os.listdir(folder)} == {"hot": 1, "a": 1, "b": 1, "bad": 1}


def test_a_job_that_dies_resumes_from_what_it_saved(spark, tmp_path):
    import os

    folder, path = tmp_path / "calls", str(tmp_path / "cache")
    folder.mkdir()
    many = spark.createDataFrame([(i, f"text{i}") for i in range(40)], "id long, t string")
    with pytest.raises(Exception):
        enrich.enrich(many, cache(spark), "t", "v", "id", counting(str(folder), "text7"), batch_rows=1, cache_path=path)
    done = {r["t"] for r in spark.read.parquet(path).collect()}
    assert done and "text7" not in done
    before = {t: os.path.getsize(folder / t) for t in done}
    out = enrich.enrich(many, cache(spark), "t", "v", "id", counting(str(folder)), batch_rows=1, cache_path=path)
    assert enrich.status_counts(out).first()["n_translated"] == 40
    assert {t: os.path.getsize(folder / t) for t in done} == before


def test_sampled_run(spark):
    out = enrich.enrich(rows(spark), cache(spark), "t", "v", "id", service, sample=20)
    assert out.count() == 20


def test_hot_keys_are_served_apart_with_the_same_result(spark):
    left = rows(spark).withColumn("t", F.when(F.col("id") != 7, F.col("t")))
    lookup = spark.createDataFrame([("hot", 1), ("a", 2), ("zzz", 3)], "t string, x int")
    for how in ("left", "inner", "left_semi", "left_anti"):
        small = sorted(map(tuple, skew.lookup_join(left, lookup, "t", how).collect()), key=repr)
        large = sorted(map(tuple, skew.lookup_join(left, lookup, "t", how, max_rows=0).collect()), key=repr)
        assert small == large


def test_enrich_stream_replays_without_doubling(spark, tmp_path):
    source = str(tmp_path / "in")
    rows(spark).coalesce(1).write.parquet(source)
    for run in range(2):
        stream = spark.readStream.schema("id long, t string").parquet(source)
        query = adapters.enrich_stream(
            stream, "t", "v", "id", service, str(tmp_path / "cache"), str(tmp_path / "out"),
            str(tmp_path / f"cp{run}"), availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 305
    assert out.filter("status = 'failed'").count() == 1
    assert out.filter("status = 'resumed'").count() == 304
