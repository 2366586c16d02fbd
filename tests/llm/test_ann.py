import numpy as np
from pyspark.sql import functions as F

from vitalscope.llm import ann


def brute(rows, asked, k):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and len(v) == 4 and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q in sorted({i for i, _ in fine if asked(i)}):
        own = min((v.tolist() for i, v in fine if i == q))
        near = sorted((float(np.sqrt(((v - own) ** 2).sum())), i) for i, v in fine if i != q)
        out[q] = near[:k]
    return out


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(1, 120)] + [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(200, 230)]
    rows += [(500, None), (510, [0.0] * 4), (520, [1.0, None, 1.0, 1.0]), (530, [float("nan")] * 4), (540, [float("inf"), 1.0, 1.0, 1.0]), (550, [1.0] * 3), (None, [1.0] * 4), (10, [9.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'clash' as part", "'clash' as v")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = ann.search(df, F.col("vec_id") % 10 == 0).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    want = brute(rows, lambda i: i % 10 == 0, 10)
    assert set(found) == set(want)
    for q in want:
        assert [i for _, i in found[q]] == [i for _, i in want[q]]
        assert np.allclose([s for s, _ in found[q]], [s for s, _ in want[q]], rtol=0, atol=1e-12)
    assert ann.search(df.limit(0), F.col("vec_id") % 10 == 0).collect() == []


def test_recall_and_tiles(spark, folder, monkeypatch):
    monkeypatch.setattr(ann, "ROWS", 300)
    monkeypatch.setattr(ann, "QUERIES", 7)
    table = spark.read.parquet(folder.replace("0.001", "0.1") + "/embeddings.parquet")
    got = ann.search(table, F.col("vec_id") % 100 == 0).collect()
    data = table.collect()
    ids, x = np.array([r["vec_id"] for r in data]), np.array([r["embedding"] for r in data], float)
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        near = set(ids[np.lexsort((ids, d))[:10]].tolist())
        mine = [r["vec_id"] for r in got if r["query_id"] == ids[q]]
        assert len(mine) == 10
        hits, total = hits + len(near & set(mine)), total + 10
    assert hits >= 0.9 * total
