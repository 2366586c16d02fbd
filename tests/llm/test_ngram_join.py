import collections
import random

import pytest

from vitalscope.llm import ngram_join

from .helpers import LONG, WORD, docs_of, empty_docs, sorted_rows


def shingles(text, k):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(w) < k:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def brute(rows, k, share):
    sets, parent, index = [shingles(t, k) for _, t in rows], list(range(len(rows))), collections.defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, s in enumerate(sets):
        if s and rows[i][0] is not None:
            for j, n in collections.Counter(j for g in s for j in index[g]).items():
                if 100 * n >= share * (len(s) + len(sets[j]) - n):
                    parent[find(i)] = find(j)
            for g in s:
                index[g].append(i)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(sets[i]), None if d is None else low[find(i)]) for i, (d, _) in enumerate(rows)]


@pytest.fixture(scope="module")
def rows():
    random.seed(5)
    rows, d = [(0, None), (1, ""), (2, "  "), (None, "a b c d"), (3, LONG[:20_000]), (4, LONG[:19_000])], 5
    for _ in range(25):
        n = random.choice([1, 2, 5, 9, 10, 12, 20, 30, 60, 150, 400])
        base = [random.choice("abcdefghijklmnop") + str(random.randint(0, 40)) for _ in range(n)]
        for _ in range(random.randint(1, 12)):
            w = list(base)
            for _ in range(random.choice([0, 0, 1, 1, 2, 3, int(n * 0.02), int(n * 0.04)])):
                i = random.randrange(len(w) + 1)
                if random.random() < 0.5:
                    w.insert(i, f"zz{random.randint(0, 9)}")
                elif len(w) > 1:
                    w.pop(min(i, len(w) - 1))
            base = random.choice([base, w])
            rows.append((d, " ".join(w).upper() if random.random() < 0.2 else " ".join(w)))
            d += 1
    return rows + [rows[10], rows[40]]


@pytest.mark.parametrize("k,share,tile", [(3, 90, 512), (5, 80, 3), (2, 60, 512)])
def test_equals_brute_force(spark, rows, monkeypatch, k, share, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    got = ngram_join.link_components(docs_of(spark, rows), k=k, share=share).collect()
    assert sorted_rows(got) == sorted_rows(brute(rows, k, share))


def test_tree_misses_nothing():
    import numpy as np

    rng = np.random.default_rng(1)
    points = rng.poisson(3, (700, ngram_join.COUNTS)).astype(np.uint32)
    points[350:] = np.maximum(points[:350].astype(int) + rng.integers(-1, 2, (350, ngram_join.COUNTS)) * (rng.random((350, ngram_join.COUNTS)) < 0.1), 0)
    size = points.sum(1).astype(np.int64)
    tree = ngram_join.RTree(points, size)
    for i in range(0, 700, 50):
        want = np.flatnonzero(np.minimum(points, points[i]).sum(1) >= ngram_join.needed(size[i], size, 90))
        assert sorted(tree.search(points[i], int(size[i]), 90).tolist()) == want.tolist()


def test_one_of_each_group_stays(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(5, long), (3, long + " more"), (9, "other text of its own here"), (None, long), (7, None), (8, ""), (9, "other text of its own here")]
    kept = ngram_join.drop_near_copies(docs_of(spark, rows))
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == [3, 7, 8, 9, None]
    assert kept.columns == docs_of(spark, rows).columns
    assert ngram_join.link_components(empty_docs(spark)).collect() == []


def test_repeated_rows_keep_every_link(spark):
    # The second and third of each family link to the first only, by different pages.
    rows = []
    for i in range(60):
        base, *ends = ([f"f{i}{c}{j}" for j in range(n)] for c, n in (("x", 58), ("y", 6), ("z", 6)))
        rows += [(10 * i + 5, " ".join(base)), (10 * i + 7, " ".join(base + ends[0])), (10 * i + 9, " ".join(ends[1] + base))]
    got = ngram_join.link_components(docs_of(spark, rows + rows)).collect()
    assert sorted_rows(got) == sorted_rows(brute(rows + rows, 3, 90))


def test_pages_of_one_document_are_not_stored(spark, monkeypatch):
    random.seed(8)
    text = lambda: " ".join(f"w{random.randrange(10**6)}" for _ in range(300))
    texts = [text() for _ in range(40)]
    rows = [*enumerate(texts), (40, texts[3] + " end"), (41, texts[3])]
    tables, real = [], ngram_join.stored
    monkeypatch.setattr(ngram_join, "stored", lambda df: tables.append(real(df)) or tables[-1])
    got = sorted_rows(ngram_join.link_components(docs_of(spark, rows), k=5, share=80).collect())
    assert got == sorted_rows(brute(rows, 5, 80))
    assert not any("pages" in t.columns for t in tables)
    held = [t.count() for t in tables if t.columns == ["page", "doc_id"]]
    assert held and max(held) < 1000  # of 7,766 page rows; the rest have one member


def test_points_are_as_narrow_as_their_counts():
    import numpy as np

    points = np.zeros((4, ngram_join.COUNTS), np.int64)
    points[0, 3], points[1, 5], points[2, 7] = 255, 256, 70_000
    rows = ngram_join.packed(points)
    assert [len(r) // ngram_join.COUNTS for r in rows] == [1, 2, 4, 1]
    assert (ngram_join.unpacked(rows) == points).all() and ngram_join.unpacked([]).shape == (0, ngram_join.COUNTS)
