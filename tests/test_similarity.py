import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalscope.functions import vectors as vx
from vitalscope.operators import similarity as sim
from vitalscope.plans import study

RNG = np.random.default_rng(5)
# One cluster holds most rows; there are a zero, a constant, copies and a loner.
VECTORS = [(i, "big", RNG.normal(size=6).tolist()) for i in range(90)]
VECTORS += [(100 + i, "small", RNG.normal(size=6).tolist()) for i in range(7)]
VECTORS += [(200, "odd", [0.0] * 6), (201, "odd", [2.0] * 6), (202, "odd", [-2.0] * 6),
            (203, "odd", [4.0] * 6), (300, "loner", RNG.normal(size=6).tolist())]
VECTORS += [(400, "small", VECTORS[3][2]), (401, "big", VECTORS[3][2])]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(VECTORS, "id long, c string, v array<double>").repartition(3)


def unit(v):
    v = np.array(v)
    return v / max(np.linalg.norm(v), 1e-12)


def cosine(a, b):
    return float(unit(a) @ unit(b))


def pearson(a, b):
    if max(a) == min(a) or max(b) == min(b):
        return 0.0
    return float(np.corrcoef(a, b)[0, 1])


def pairs(same=True):
    for (i, c, a), (j, d, b) in itertools.combinations(VECTORS, 2):
        if (c == d) == same:
            yield c, i, j, a, b


@pytest.mark.parametrize("block", [8, 64, 4096])
def test_cluster_summary_equals_brute_force(df, block):
    got = {r["cluster"]: r for r in sim.cluster_summary(df, "id", "v", "c", 0.5, block).collect()}
    assert got["loner"]["n_pairs"] == 0 and got["loner"]["mean_cosine_similarity"] is None
    assert got["loner"]["pct_above"] == 0.0
    for name in ("big", "small", "odd"):
        mine = [(np.clip(cosine(a, b), 0, 1), pearson(a, b), np.linalg.norm(np.subtract(a, b)))
                for c, _, _, a, b in pairs() if c == name]
        s = [m[0] for m in mine]
        row = got[name]
        assert row["n_pairs"] == len(mine)
        assert row["mean_cosine_similarity"] == pytest.approx(np.mean(s))
        assert row["min_cosine_similarity"] == pytest.approx(min(s), abs=1e-12)
        assert row["max_cosine_similarity"] == pytest.approx(max(s))
        assert row["mean_pearson_correlation"] == pytest.approx(np.mean([m[1] for m in mine]))
        assert row["mean_euclidean_distance"] == pytest.approx(np.mean([m[2] for m in mine]))
        assert row["pairs_above"] == sum(x > 0.5 for x in s)


@pytest.mark.parametrize("block", [16, 4096])
def test_pairs_above_and_all_pairs(df, block):
    def by_hand(threshold):
        return {(i, j) for _, i, j, a, b in pairs() if np.clip(cosine(a, b), 0, 1) > threshold}

    for threshold in (0.5, -1.0):
        got = sim.pairs_above(df, "id", "v", "c", threshold, block).collect()
        assert {(r["id_a"], r["id_b"]) for r in got} == by_hand(threshold)
        assert len(got) == len(by_hand(threshold))


@pytest.mark.parametrize("block", [16, 4096])
def test_separation(df, block):
    row = sim.separation(df, "id", "v", "c", block_rows=block).first()
    within = [np.clip(cosine(a, b), 0, 1) for *_, a, b in pairs(True)]
    across = [np.clip(cosine(a, b), 0, 1) for *_, a, b in pairs(False)]
    assert (row["within_pairs"], row["across_pairs"]) == (len(within), len(across))
    assert row["within_pairs"] + row["across_pairs"] == len(VECTORS) * (len(VECTORS) - 1) // 2
    assert row["within_mean"] == pytest.approx(np.mean(within))
    assert row["across_mean"] == pytest.approx(np.mean(across))
    assert row["separation_gap"] == pytest.approx(np.mean(within) - np.mean(across))


@pytest.mark.parametrize("block", [16, 4096])
def test_group_similarity(df, block):
    got = {r["group"]: r for r in sim.group_similarity(df, "id", "v", "c", block_rows=block).collect()}
    assert got["loner"]["n_rows"] == 1 and got["loner"]["median_similarity"] is None
    big = [cosine(a, b) for c, _, _, a, b in pairs() if c == "big"]
    assert got["big"]["mean_similarity"] == pytest.approx(np.mean(big))
    assert got["big"]["median_similarity"] == pytest.approx(np.median(np.round(big, 4)))
    assert got["big"]["min_similarity"] == pytest.approx(min(big), abs=1e-4)


def test_arm_summary_needs_no_pairs_for_its_means(df):
    got = {r["cluster"]: r for r in sim.arm_summary(df, "id", "v", "c", 0.3, 16).collect()}
    for name in ("big", "small", "odd"):
        inner = [cosine(a, b) for c, _, _, a, b in pairs() if c == name]
        outer = [cosine(a, b) for (_, c, a) in VECTORS for (_, d, b) in VECTORS if c == name and d != name]
        assert got[name]["within"] == pytest.approx(np.mean(inner))
        assert got[name]["across"] == pytest.approx(np.mean(outer))
        assert got[name]["pass_rate"] == pytest.approx(100 * np.mean([s > 0.3 for s in inner]))
        assert got[name]["n_pairs"] == len(inner)


def nearest_by_hand(left, right):
    out = {}
    for i, _, a in left:
        best = max(((round(cosine(a, b), 10), -j) for j, _, b in right if j != i), default=None)
        out[i] = (-best[1], best[0])
    return out


@pytest.mark.parametrize("block", [16, 4096])
def test_nearest_closed_excludes_itself_and_breaks_ties_by_key(df, block):
    got = {r["key"]: r for r in sim.nearest_closed(df, "id", "v", "c", block).collect()}
    expected = nearest_by_hand(VECTORS, VECTORS)
    assert {k: r["neighbour"] for k, r in got.items()} == {k: n for k, (n, _) in expected.items()}
    assert got[3]["neighbour"] == 400 and got[401]["neighbour"] == 3
    assert got[3]["same_meaning"] is False


def test_nearest_open_keeps_the_closed_neighbour_on_ties(df):
    mine, pool = df.filter("c <> 'small'"), df.filter("c = 'small'")
    closed = sim.nearest_closed(mine, "id", "v", "c", 16)
    got = {r["key"]: r for r in sim.nearest_open(closed, mine, pool, "id", "v", 16).collect()}
    left = [v for v in VECTORS if v[1] != "small"]
    inner = nearest_by_hand(left, left)
    outer = nearest_by_hand(left, [v for v in VECTORS if v[1] == "small"])
    for key, row in got.items():
        stays = inner[key][1] >= outer[key][1]
        assert row["open_pool_neighbour"] == (inner[key][0] if stays else outer[key][0])
        assert row["open_pool_same_meaning"] == (stays and row["same_meaning"])
    assert got[3]["open_pool_neighbour"] == 401  # a copy in each set: the closed one wins
    eff = sim.neighbour_efficiency(spark_of(got, df)).first()
    assert eff["n_rows"] == len(left)


def spark_of(rows, df):
    return df.sparkSession.createDataFrame(list(rows.values()))


@pytest.mark.parametrize("block", [16, 4096])
def test_top_similar(df, block):
    queries, corpus = df.filter("c = 'small'"), df.filter("c = 'big'")
    got = sim.top_similar(queries, corpus, "id", "v", 4, block).collect()
    for i, c, a in VECTORS:
        if c == "small":
            best = sorted((-round(cosine(a, b), 10), j) for j, d, b in VECTORS if d == "big")[:4]
            mine = sorted((r["rank"], r["neighbour"]) for r in got if r["query"] == i)
            assert [n for _, n in mine] == [j for _, j in best]


def test_expressions_on_edge_vectors(spark):
    df = spark.createDataFrame(
        [([0.0, 0.0], [1.0, 2.0]), ([1.0, 1.0], [1.0, 2.0]), ([1.0, 2.0], [-1.0, -2.0])],
        "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = df.select(vx.cosine(a, b), vx.cosine_raw(a, b), vx.pearson(a, b), vx.euclidean(a, b)).collect()
    assert tuple(got[0])[:3] == (0.0, 0.0, 0.0)
    assert got[1][2] == 0.0
    assert got[2][0] == 0.0 and got[2][1] == pytest.approx(-1.0) and got[2][2] == pytest.approx(-1.0)


def test_vector_contract(spark, df):
    good = sim.vector_contract(df, "id", "v", df.select("id"), 6).first()
    assert good["is_valid"] and good["n_missing"] == 0
    assert not sim.vector_contract(df, "id", "v", None, 7).first()["is_valid"]
    assert not sim.vector_contract(df.limit(0), "id", "v").first()["is_valid"]
    more = spark.createDataFrame([(999,)], "id long").unionByName(df.select("id"))
    assert sim.vector_contract(df, "id", "v", more).first()["n_missing"] == 1
    broken = spark.createDataFrame([(1, [1.0, float("nan")])], "id long, v array<double>")
    assert sim.vector_contract(broken, "id", "v").first()["n_not_finite"] == 1


def test_pair_check(spark):
    raw = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, v array<double>")
    norm = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "id int, v array<double>")
    listed = spark.createDataFrame([(7, 1, 2, 0.99)], "pair_id int, left_id int, right_id int, documented double")
    row = sim.pair_check(listed, raw, norm, "id", "v").first()
    assert (row["raw"], row["normalized"], row["lift"]) == (0.0, 1.0, 1.0)
    assert row["passes_threshold"] and row["matches_documented"]
    total = sim.pair_check_summary(sim.pair_check(listed, raw, norm, "id", "v")).first()
    assert total["pairs_below_threshold"] == 0 and total["mean_lift"] == 1.0


def test_study_tables(df):
    mine, pool = df.filter("c <> 'small'"), df.filter("c = 'small'")
    out = study.run(mine, "id", "v", "c", pool, encoder="test", preprocessing="raw")
    rows = {r["cluster"]: r for r in out["summary"].collect()}
    assert set(rows) == {"big", "odd", "loner", "OVERALL"}
    assert rows["OVERALL"]["n_pairs"] == sum(rows[c]["n_pairs"] for c in ("big", "odd", "loner"))
    assert rows["OVERALL"]["embedding_dim"] == 6 and rows["big"]["embedding_dim"] is None
    assert rows["OVERALL"]["nn_efficiency_open_pool_pct"] <= rows["OVERALL"]["nn_efficiency_closed_pool_pct"]
    assert "pairs_above_0.5" in out["summary"].columns
    assert out["neighbours"].count() == mine.count()
