import random

import pytest
from pyspark.sql import functions as F

from vitalscope.functions import repair
from vitalscope.operators import corpus, evaluation as ev, sampling

# Class 3 is never predicted, class 2 has no rows.
CELLS = [(0, 0, 6), (0, 1, 2), (1, 0, 1), (1, 1, 3), (1, 2, 1), (3, 1, 2)]


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame(CELLS, "label int, prediction int, n long")


def test_confusion_grid_shows_every_cell(spark, cells):
    long = spark.createDataFrame([(a, b) for a, b, n in CELLS for _ in range(n)], "label int, prediction int")
    counted = ev.confusion(long)
    assert sorted(map(tuple, counted.collect())) == sorted(CELLS)
    grid = ev.confusion_grid(counted).collect()
    assert len(grid) == 16 and sum(r["n"] for r in grid) == 15
    wide = {r["label"]: r for r in ev.confusion_wide(counted, 4).collect()}
    assert wide[2]["pred_0"] == 0 and wide[0]["pred_1"] == 2


def test_rates_and_grades(cells):
    row = ev.error_rates(cells).first()
    assert row["accuracy"] + row["under_triage_pct"] + row["over_triage_pct"] == pytest.approx(100)
    assert row["over_triage_pct"] == pytest.approx(20.0)
    assert row["under_triage_pct"] == pytest.approx(20.0)
    assert (row["safety_grade"], row["efficiency_grade"]) == ("F", "B")
    rates = {r["label"]: r for r in ev.class_rates(cells).collect()}
    assert rates[3]["over_triage_rate"] == 100.0 and rates[0]["under_triage_rate"] == 25.0
    patterns = {(r["label"], r["prediction"]): r for r in ev.error_patterns(cells).collect()}
    assert patterns[(3, 1)]["direction"].startswith("UPGRADED") and (0, 0) not in patterns
    assert patterns[(1, 2)]["share_pct"] == pytest.approx(20.0)


def test_report_divides_by_zero_as_zero(cells):
    report = {r["class"]: r for r in ev.weak_classes(ev.class_report(cells)).collect()}
    assert report[2]["support"] == 0 and report[2]["recall"] == 0 and report[2]["f1"] == 0
    assert report[3]["precision"] == 0 and report[3]["is_tiny"] and report[3]["is_weak"]
    assert report[0]["precision"] == pytest.approx(6 / 7) and report[0]["recall"] == 0.75
    averages = ev.report_averages(ev.class_report(cells)).first()
    assert averages["macro_recall"] == pytest.approx((0.75 + 0.6 + 0 + 0) / 4)
    assert averages["weighted_recall"] == pytest.approx(9 / 15)


def methods(spark):
    return spark.createDataFrame(
        [(0, "A", 90.0, 5.0, 5.0), (1, "B", 92.0, 6.0, 2.0), (2, "C", 91.0, 5.4, 3.6), (3, "D", 91.0, 5.4, 3.6)],
        "ord int, method string, accuracy double, under_triage_pct double, over_triage_pct double")


def test_selection_is_safety_first(spark):
    table = methods(spark)
    assert ev.most_accurate(table).first()["method"] == "B"
    assert ev.select_method(table).first()["method"] == "C"
    assert ev.select_method(table, tolerance=0.0).first()["method"] == "A"
    cost = ev.override_cost(table, "B").first()
    assert cost["automatic_method"] == "C" and cost["under_triage_cost"] == pytest.approx(0.6)
    change = {r["method"]: r for r in ev.against_baseline(table, "A").collect()}
    assert change["C"]["accuracy_change"] == pytest.approx(1.0)
    assert ev.ablation(table, "A", "C").first()["verdict"] == "helped"
    assert ev.ablation(table, "C", "D").first()["verdict"] == "no change"
    assert ev.ablation(table, "B", "B").first()["verdict"] == "no change"


def test_grade_bands(spark):
    df = spark.createDataFrame([(x,) for x in (4.99, 5.0, 14.9, 15.0, 20.0, 35.0)], "x double")
    got = df.select(repair.safety_grade(F.col("x")), repair.efficiency_grade(F.col("x"))).collect()
    assert [r[0] for r in got] == ["A+", "A", "B", "C", "F", "F"]
    assert [r[1] for r in got] == ["A", "A", "A", "B", "B", "D"]
    bands = spark.createDataFrame([(0.7,), (0.5,), (0.49,)], "x double").select(repair.match_verdict(F.col("x")))
    assert [r[0] for r in bands.collect()] == ["confident", "usable", "weak"]


def records(spark, n=600):
    rnd = random.Random(3)
    # One class holds most rows, one has a single row.
    rows = [(i, 0 if rnd.random() < 0.7 else rnd.choice([1, 2])) for i in range(n)] + [(n, 9)]
    return spark.createDataFrame(rows, "id long, label int")


def test_split_has_exact_class_sizes_and_ignores_partitions(spark):
    df = records(spark)
    a = sampling.stratified_split(df.repartition(1), "id", "label")
    b = sampling.stratified_split(df.repartition(9), "id", "label")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    for row in a.groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect():
        assert row["t"] == int(row["n"] * 0.2 + 0.5)
    other = sampling.stratified_split(df, "id", "label", seed=7)
    assert sorted(map(tuple, a.collect())) != sorted(map(tuple, other.collect()))


def test_rank_is_the_order_of_the_digest(spark):
    df = records(spark)
    ranks = {r["id"]: (r["label"], r["rank"]) for r in sampling.ranked(df, "id", "label", 42).collect()}
    from hashlib import md5
    for label in (0, 1, 2, 9):
        ids = sorted((md5(f"{i}-42".encode()).hexdigest(), i) for i, (l, _) in ranks.items() if l == label)
        assert [ranks[i][1] for _, i in ids] == list(range(1, len(ids) + 1))


def test_folds_are_even_within_each_class(spark):
    folds = sampling.stratified_folds(records(spark), "id", "label", 5)
    for label, sizes in _sizes(folds).items():
        assert max(sizes.values()) - min(sizes.values()) <= 1 or label == 9


def _sizes(folds):
    out: dict = {}
    for r in folds.groupBy("label", "fold").count().collect():
        out.setdefault(r["label"], {})[r["fold"]] = r["count"]
    return out


def test_samples(spark):
    df = records(spark)
    assert sampling.sample_exactly(df, "id", 40).count() == 40
    assert sampling.sample_exactly(df, "id", 10_000).count() == 601
    per = sampling.sample_per_group(df, "id", "label", 5).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in per} == {0: 5, 1: 5, 2: 5, 9: 1}


def test_meaning_clusters_take_each_row_once(spark):
    texts = [(i, "sēna dárd" if i < 8 else "sēna dárd sāns" if i < 14 else "sāns") for i in range(20)]
    df = spark.createDataFrame(texts, "id long, t string")
    rules = {"pain": [["sēna", "dárd"]], "breath": [["sāns"], ["phūlna"]], "none": [["zzz"]]}
    rows = sampling.meaning_clusters(df, "id", "t", rules, 6).collect()
    assert len(rows) == 12 and len({r["id"] for r in rows}) == 12
    assert {r["cluster"] for r in rows} == {"pain", "breath"}


def test_weights_and_large_groups(spark):
    df = records(spark)
    weights = {r["label"]: r for r in sampling.class_weights(df, "label").collect()}
    assert sum(r["weight"] * r["n"] for r in weights.values()) == pytest.approx(601)
    assert weights[9]["weight"] == pytest.approx(601 / 4)
    assert sampling.large_enough_groups(df, "label", 2).filter("label = 9").count() == 0


def test_distribution_shows_empty_levels(spark):
    df = spark.createDataFrame([(1,), (1,), (3,)], "level int")
    got = {r["label"]: r["n"] for r in corpus.class_distribution(df, "level", range(1, 5)).collect()}
    assert got == {1: 2, 2: 0, 3: 1, 4: 0}


def test_leakage_audit_both_ways(spark, monkeypatch):
    docs = [(i, ["hai", "a" if i % 2 else "b", f"w{i}"], i % 2) for i in range(30)]
    df = spark.createDataFrame(docs, "id int, tokens array<string>, label int")
    expected = (33, 32, 30, 30)
    assert tuple(corpus.leakage_audit(df, "id").first()) == expected
    monkeypatch.setattr(corpus, "small_rows", lambda d, n=0: None)
    assert tuple(corpus.leakage_audit(df, "id").first()) == expected


def test_record_contradictions(spark):
    rows = [("dhadkan TEZ", "Bradycardia", 50, 2), ("dard", "Bradycardia", 126, 2), ("behoshi", "Normal", 80, 4),
            ("theek ho jata hai", "Normal", 80, 1), ("dard", "Normal", 80, 1)]
    df = spark.createDataFrame(rows, "t string, e string, h int, l int")
    got = df.select(corpus.record_contradictions(*[F.col(c) for c in "tehl"]).alias("x")).collect()
    assert [r["x"] for r in got] == [["text_vs_rhythm"], ["rate_vs_rhythm"], ["red_flag_at_low_acuity"],
                                     ["reassurance_at_high_acuity"], []]
