import random

import numpy as np
import pytest
import xxhash

from vitalscope.llm import simhash

from .helpers import LONG, WORD, docs_of, empty_docs, sorted_rows


def own_print(text, k=3):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reached(prints, within=3):
    """Smallest doc_id that each (doc_id, fingerprint) reaches."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for i, (d, f) in enumerate(prints):
        for j in range(i):
            if d is not None and prints[j][0] is not None and (f ^ prints[j][1]).bit_count() <= within:
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [None if d is None else low[find(i)] for i, (d, _) in enumerate(prints)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    rows, d = [(0, None), (1, ""), (2, " \t\n"), (None, "a b c d"), (3, "two words"), (4, "Two  WORDS"), (5, LONG[:30_000]), (None, None)], 6
    for _ in range(60):
        words = [f"w{rng.randrange(400)}é" for _ in range(rng.choice([1, 3, 8, 40, 200]))]
        for _ in range(rng.randint(1, 6)):
            new = list(words)
            for _ in range(rng.choice([0, 0, 1, 2])):
                new[rng.randrange(len(new))] = rng.choice(["Changed", "x", "\x1cy"])
            rows.append((d, rng.choice([" ", "  ", "\n"]).join(new)))
            d += 1
    rows.append((7, "same id other text"))
    return rows + rows[10:30]


def test_equals_brute_force(spark, rows):
    got = simhash.near_duplicates(docs_of(spark, rows)).collect()
    prints = [(d, own_print(t)) for d, t in rows]
    want = [(d, f"{f:016x}", c) for (d, f), c in zip(prints, reached(prints))]
    assert sorted_rows(got) == sorted_rows(want)


def heaps(rng, n):
    """Fingerprints alone, in chains of small steps, and in dense heaps."""
    out = []
    while len(out) < n:
        base = rng.getrandbits(64)
        kind = rng.random()
        for _ in range(1 if kind < 0.5 else rng.randint(2, 12) if kind < 0.9 else 120):
            out.append(base)
            new = base
            for _ in range(rng.randint(1, 5)):
                new ^= 1 << rng.randrange(64)
            base = new if kind < 0.9 else base ^ (1 << rng.randrange(64)) if rng.random() < 0.3 else base
            out.append(new)
    return out


@pytest.mark.parametrize("within,homes,per", [(3, 1024, 20), (3, 8, 1), (0, 64, 20), (5, 16, 100)])
def test_classes_equal_brute_force(spark, monkeypatch, within, homes, per):
    monkeypatch.setattr(simhash, "HOMES", homes)
    monkeypatch.setattr(simhash, "ALL", 4 * homes)
    monkeypatch.setattr(simhash, "PER_PIVOT", per)
    rng = random.Random(within + homes)
    prints = list(enumerate(heaps(rng, 1500), 10))
    rng.shuffle(prints)
    df = spark.createDataFrame([(d, f - (f >> 63 << 64)) for d, f in prints], "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash.classes(df, within).collect()}
    want = reached(prints, within)
    assert [got.get(f - (f >> 63 << 64), d) for d, f in prints] == want


def test_every_link_meets_in_a_cell():
    rng = np.random.default_rng(1)
    pivots = rng.integers(0, 2**64, 300, dtype=np.uint64)
    a = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    b = a.copy()
    for _ in range(3):
        b ^= np.uint64(1) << rng.integers(0, 64, 2000).astype(np.uint64)
    x, y = simhash.distances(a, pivots), simhash.distances(b, pivots)
    far = x.min(1) >= y.min(1)
    met = np.where(far, x[np.arange(2000), y.argmin(1)] <= x.min(1) + 3, y[np.arange(2000), x.argmin(1)] <= y.min(1) + 3)
    assert met.all()


def test_empty_table(spark):
    assert simhash.near_duplicates(empty_docs(spark)).collect() == []
