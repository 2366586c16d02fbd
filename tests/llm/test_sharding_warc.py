import base64
import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from vitalscope.llm import sharding, warc

from .helpers import LONG, docs_of, empty_docs


def test_shards_fit_and_copies_spread(spark, tmp_path):
    rows = [(i, "x" * (i % 50)) for i in range(300)] + [(7, "same")] * 200 + [(None, None), (-1, ""), (-2, LONG)]
    df = docs_of(spark, rows)
    got = sharding.assign(df, 500).collect()
    assert len(got) == len(rows)
    shards = collections.defaultdict(list)
    for r in got:
        shards[r["depth"], r["prefix"]].append(r)
    for members in shards.values():
        assert sum(r["bytes"] for r in members) == members[0]["shard_bytes"]
        assert len(members) == members[0]["shard_rows"]
        assert members[0]["shard_bytes"] <= 500 or len(members) == 1
    assert sharding.assign(empty_docs(spark), 500).collect() == []
    whole = sharding.assign(df, 10**9).collect()
    assert {(r["depth"], r["prefix"]) for r in whole} == {(0, 0)}
    sharding.write_shards(df, str(tmp_path / "out"), 500)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def by_hand(rows, limit):
    """Shards (depth, prefix) and their rows by splitting one bit at a time."""
    seen, marks = collections.Counter(), []
    for d, n in rows:
        seen[d, n] += 1
        name = f"{'null' if d is None else d}:{n}:{seen[d, n]}"
        marks.append((int(hashlib.md5(name.encode()).hexdigest()[:15], 16), n))
    out, open_ = {}, [(0, 0, marks)]
    while open_:
        depth, prefix, own = open_.pop()
        if sum(n for _, n in own) <= limit or len(own) == 1 or depth == 60:
            out[depth, prefix] = len(own)
            continue
        for bit in (0, 1):
            part = [m for m in own if m[0] >> (59 - depth) & 1 == bit]
            if part:
                open_.append((depth + 1, 2 * prefix + bit, part))
    return out


@pytest.mark.parametrize("most", [100_000, 3])
def test_directory_equals_splitting_by_hand(spark, monkeypatch, most):
    monkeypatch.setattr(sharding, "DIRECTORY_ROWS", most)
    rows = [(i % 900, 1 + i % 37) for i in range(2500)] + [(None, 5)] * 40 + [(3, 4000)]
    df = spark.createDataFrame([(d, "x" * n) for d, n in rows], "doc_id long, text string")
    for limit in (10**9, 700, 15):
        want = by_hand(rows, limit)
        got = collections.Counter((r["depth"], r["prefix"]) for r in sharding.assign(df, limit).collect())
        assert got == want
    got = collections.Counter((r["depth"], r["prefix"]) for r in sharding.written(df, 700).collect())
    assert got == by_hand(rows, 700)


def test_more_equal_rows_than_a_chunk_and_5000_shards(spark, tmp_path):
    df = spark.range(70_000).select(F.lit(7).alias("doc_id"), F.lit("same text").alias("text")).repartition(3)
    path = str(tmp_path / "hot")
    sharding.write_shards(df, path, 10_000, copy="copy")
    rows = spark.read.parquet(path)
    assert rows.select("copy").distinct().count() == 70_000
    assert rows.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("n")).agg(F.max("n")).first()[0] <= 10_000
    many = spark.range(12_000).select(F.col("id").alias("doc_id"), F.lit("x" * 50).alias("text"))
    slim = sharding.stored(sharding.keyed(many))
    shards = sharding.directory(slim, 100)
    assert shards.count() > 5_000
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sharding._placed(many.withColumn("__h", F.col("doc_id")), shards)[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_plan_has_no_python(spark):
    plan = sharding.assign(docs_of(spark, [(1, "a")]), 10)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_archives_round_trip(spark, folder, monkeypatch):
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    more = [(-1, "u v\r\n", None), (-2, None, ""), (10**9, "é", "dup"), (10**9 + 5, "b", "dup"), (10**9 + 5, "b", "dup"), (None, "c", "dup"), (-3, "l", LONG)]
    pages = pages.unionByName(spark.createDataFrame(more, pages.schema)).selectExpr("*", "'clash' as refers", "'clash' as frame")
    rows = pages.collect()
    order = lambda v: -(2**63) if v is None else v
    groups = collections.defaultdict(list)
    for r in rows:
        groups[(r["html"] or "").encode()].append(r["page_id"])

    def want(least):
        for r in rows:
            raw = (r["html"] or "").encode()
            last = max(groups[raw], key=order)
            again = len(raw) >= least and order(r["page_id"]) < order(last)
            sha = base64.b32encode(hashlib.sha1(raw).digest()).decode()
            yield r["page_id"], len(raw), sha, "revisit" if again else "response", last if again else None
    for least, records, few in ((0, 2048, 1000), (4, 7, 0)):
        monkeypatch.setattr(warc, "RECORDS", records)
        monkeypatch.setattr(warc, "FEW_GROUPS", few)
        assert sorted(map(tuple, warc.round_trip(pages, least).collect()), key=repr) == sorted(want(least), key=repr)
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_payloads_and_damage(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "text"), (2, None, "text"), (3, "u", None)], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write(pages, path)
    got = {r["page_id"]: (r["record_type"], bytes(r["payload"])) for r in warc.read(spark, path, payload=True).collect()}
    assert got == {1: ("revisit", b""), 2: ("response", b"text"), 3: ("response", b"")}
    import zstandard

    data = zstandard.ZstdCompressor(write_checksum=True).compress(warc.record(1, "u", b"abc", warc.digest(b"abc"), None))
    dictionary, frames = warc.split_frames(warc.GAP + data + warc.GAP + data)
    assert dictionary == b"" and frames == [data, data]
    for broken in (data[:-3], b"junk" + data, data + b"\x01\x02"):
        with pytest.raises(ValueError):
            warc.split_frames(broken)
    raw = warc.record(1, "u", b"abc", warc.digest(b"abc"), None)
    for broken in (raw.replace(b"abc", b"abd"), raw.replace(b"WARC/1.1", b"WARC/9.9"), raw[:-1], raw + b"x"):
        with pytest.raises((ValueError, KeyError)):
            warc.parse(broken)


def test_written_shards_fit_and_copies_spread(spark, tmp_path):
    rows = [(i, "x" * (i % 50)) for i in range(300)] + [(7, "same")] * 200 + [(8, "some")] * 2 + [(None, None)] * 90 + [(-1, "")]
    df = docs_of(spark, rows)
    sharding.write_shards(df, str(tmp_path / "out"), 500)
    folders = collections.defaultdict(list)
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        folders[r["shard"]].append((r["doc_id"], r["text"]))
    assert sorted((x for f in folders.values() for x in f), key=repr) == sorted(rows, key=repr)
    for members in folders.values():
        assert len(members) == 1 or sum(len(t or "") for _, t in members) <= 500
    assert sum((7, "same") in f for f in folders.values()) > 5
    want = sharding.assign(df, 500).collect()
    assert sorted(map(tuple, sharding.written(df, 500).collect()), key=repr) == sorted(map(tuple, want), key=repr)
    assert sharding.written(empty_docs(spark), 500).collect() == []
