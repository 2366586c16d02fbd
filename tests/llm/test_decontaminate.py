import random

import numpy as np

from vitalscope.llm import decontaminate

from .helpers import LONG, docs_of, empty_docs


def test_subsequence():
    random.seed(2)
    for _ in range(300):
        a, b = ([random.randrange(6) for _ in range(random.randint(1, 20))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        masks = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        assert decontaminate.common_subsequence(masks, len(a), np.array(b)) == table[-1][-1]


def test_randomised_svd_equals_numpy(spark):
    rng = np.random.default_rng(0)
    matrix = rng.normal(size=(30, 12)) @ np.diag(2.0 ** -np.arange(12)) @ np.linalg.qr(rng.normal(size=(12, 12)))[0]
    rows = spark.createDataFrame([(list(range(12)), r.tolist()) for r in matrix], "number array<long>, value array<double>")
    space = decontaminate.randomised_svd(rows.repartition(3), 12, 4)
    want = np.linalg.svd(matrix)[2][:4].T
    assert np.allclose(np.abs(np.diag(space.T @ want)), 1, atol=1e-6)


def test_finds_copies_and_paraphrases(spark):
    random.seed(3)
    word = lambda: "".join(random.choice("aeioubdfglmnprst") for _ in range(random.randint(4, 8)))
    items = [[word() for _ in range(n)] for n in (8, 20, 33, 60)]
    fill = lambda n: [word() for _ in range(n)]
    loose = list(items[2])
    for i in range(0, 33, 8):
        loose[i] = word()
    loose.insert(5, "inserted")
    rows = [
        (1, " ".join(fill(40) + items[0] + fill(30))), (2, " ".join(fill(100) + [w.upper() + "," for w in items[1]] + fill(7))),
        (3, " ".join(fill(55) + loose + fill(90))), (4, " ".join(fill(300))), (5, None), (6, ""),
        (7, LONG + " ".join(items[3])), (None, " ".join(items[3])), (8, " ".join(items[3][:20] + fill(60))),
        (2, " ".join(fill(100) + items[1])), (9, " ".join(fill(20)) + " Two words, " + " ".join(fill(9))), (11, "words two"), (12, "two"), (12, "words"),
    ]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(8, None), (9, ""), (10, "two words")], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs_of(spark, rows), bench).collect()), key=repr)
    assert got == sorted([(1, 0), (2, 1), (2, 1), (3, 2), (7, 3), (None, 3), (9, 10)], key=repr)
    assert decontaminate.matches(empty_docs(spark), bench).collect() == []
    assert decontaminate.matches(docs_of(spark, rows), bench.limit(0)).collect() == []
    kept = decontaminate.drop_contaminated(docs_of(spark, rows), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 6, 8, 11, 12, 12] and kept.columns == docs_of(spark, rows).columns


def test_finds_the_items_of_a_large_benchmark(spark):
    random.seed(6)
    words = [f"w{i}" for i in range(2500)]
    fill = lambda n: [f"other{random.randrange(500)}" for _ in range(n)]
    items = [random.sample(words, 20) for _ in range(600)]
    rows, want = [], []
    for i, item in enumerate(items):
        loose = [w for j, w in enumerate(item) if j % 7 != 3]
        loose.insert(4, "inserted")
        rows += [(2 * i, " ".join(fill(30) + item + fill(20))), (2 * i + 1, " ".join(fill(11) + loose + fill(30)))]
        want += [(2 * i, i), (2 * i + 1, i)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs_of(spark, rows), bench).collect())
    assert [g for g in got if g[0] % 2 == 0] == want[::2]
    assert len(set(got) & set(want[1::2])) >= 0.95 * len(items) and set(got) <= set(want)


def test_space_is_smaller_than_the_benchmark_and_keeps_its_paraphrases(spark, monkeypatch):
    random.seed(9)
    words = [f"w{i}" for i in range(900)]
    items = [random.sample(words, random.choice((6, 14, 25, 40))) for _ in range(400)]
    fill = lambda n: [random.choice(words) for _ in range(n)]
    short = [["one", "w3", "of"], ["solo"]]
    rows, loose = [], []
    for i, item in enumerate(items):
        rows.append((i, " ".join(fill(35) + item + fill(20))))
        if len(item) > 6:
            other = [random.choice(words) if j % 5 == 3 else w for j, w in enumerate(item)]
            rows.append((1000 + i, " ".join(fill(17) + other + fill(23))))
            loose.append(1000 + i)
    rows += [(5000, " ".join(fill(30) + short[0] + fill(3))), (5001, "Solo"), (5002, " ".join(fill(900)))]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items + short)], "item_id long, text string")
    ranks, real = [], decontaminate.latent_space
    monkeypatch.setattr(decontaminate, "latent_space", lambda *a: ranks.append(real(*a)) or ranks[-1])
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs_of(spark, rows), bench).collect()}
    assert ranks[0].shape[1] <= 128
    assert {(i, i) for i in range(400)} | {(5000, 400), (5001, 401)} <= got
    assert sum((i, i - 1000) in got for i in loose) >= 0.9 * len(loose)
    # Brute force: whatever is found holds SHARE of the item's words in order, inside a stretch of 1.25 times its length.
    texts = {i: t.lower().split() for i, t in rows}
    for doc, item in got:
        want = (items + short)[item]
        reach, masks = int(1.25 * len(want)) + 1, {w: 0 for w in want}
        for k, w in enumerate(want):
            masks[w] |= 1 << k
        stretches = [texts[doc][a:a + reach] for a in range(max(1, len(texts[doc]) - reach + 1))]
        assert max(decontaminate.common_subsequence(masks, len(want), np.array(s, object)) for s in stretches) >= 0.7 * len(want)


def test_space_is_fitted_to_every_document(spark, monkeypatch):
    random.seed(4)
    words = [f"w{i}" for i in range(300)]
    items = [[words[(8 * i + j) % 300] for j in range(20)] for i in range(40)]
    rows = [(i, " ".join(random.choice(words) for _ in range(4))) for i in range(5000)] + [(5000, "none"), (5001, None), (5002, " ".join(items[7]))]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    fitted, real = [], decontaminate.latent_space
    monkeypatch.setattr(decontaminate, "latent_space", lambda *a: fitted.append((a[1].collect(), real(*a))) or fitted[0][1])
    got = decontaminate.matches(docs_of(spark, rows), bench).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(5002, 7)]
    matrix, space = fitted[0]
    assert len(matrix) == 5001 + len(items) and space.shape == (300, 20)
    dense = np.zeros((len(matrix), 300))
    for i, r in enumerate(matrix):
        dense[i, r["number"]] = r["value"]
    best = np.sqrt((np.linalg.svd(dense, compute_uv=False)[:20] ** 2).sum())
    assert np.allclose(space.T @ space, np.eye(20), atol=1e-3) and np.linalg.norm(dense @ space) > 0.9 * best
