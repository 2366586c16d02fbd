import random

import pytest

from vitalscope.llm import graph


def brute(links):
    comp = {n: n for pair in links if None not in pair for n in pair}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a is not None and b is not None and comp[a] != comp[b]:
                comp[a] = comp[b] = min(comp[a], comp[b])
                changed = True
    return comp


@pytest.mark.parametrize("small", [True, False])
def test_components_equal_brute_force(spark, monkeypatch, small):
    random.seed(4)
    monkeypatch.setattr(graph, "is_small", lambda df: small)
    links = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 530)] + [(i, 7) for i in range(8, 12)]
    links += [(random.randrange(600, 700), random.randrange(600, 700)) for _ in range(60)]
    links += [(3, 3), (None, 4), (5, None), (8, 7), (8, 7)]
    random.shuffle(links)
    got = graph.components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()
    assert {r["node"]: r["comp"] for r in got} == brute(links) and len(got) == len(brute(links))


def test_no_links_no_rows(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_links_of_a_task_become_stars(spark, monkeypatch):
    tables = []
    own = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: tables.append(df) or own(df))
    links = [(i, i + 1) for i in range(300)] + [(900, 900)]
    random.shuffle(links)
    got = graph.components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()
    assert {r["node"]: r["comp"] for r in got} == brute(links) and len(tables) <= 3


@pytest.mark.parametrize("held", [4, 40])
def test_contracted_links_hold_the_same_together(monkeypatch, held):
    monkeypatch.setattr(graph, "HELD", held)
    random.seed(held)
    links = [(random.randrange(80), random.randrange(80)) for _ in range(60)] + [(99, 99), (98, 98), (98, 98)]
    batches = [graph.pa.RecordBatch.from_pydict({"a": [a], "b": [b]}) for a, b in links]
    for both in (False, True):
        rows = [tuple(r.values()) for batch in graph._contracted(both)(batches) for r in batch.to_pylist()]
        assert brute(rows) == brute(links) and (not both or set(rows) == {(b, a) for a, b in rows})
