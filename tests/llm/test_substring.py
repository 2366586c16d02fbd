import hashlib
import random

import pytest

from vitalscope.llm import substring

from .helpers import LONG, WORD, docs_of, empty_docs, sorted_rows


def brute(rows, size=20):
    order = lambda d: -(2**63) if d is None else d
    first, out = {}, []
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - size + 1):
            k, v = tuple(w[i:i + size]), (order(d), i)
            first[k] = min(first.get(k, v), v)
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i:i + size])] < (order(d), i):
                gone[i:i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def rows():
    random.seed(1)
    word = lambda: random.choice("abcdefgh") + random.choice(["", "x", "é"])
    base = [" ".join(word() for _ in range(60)) for _ in range(6)]
    rows = [(None, None), (1, ""), (2, " \n"), (3, None), (400, LONG)]
    for i in range(4, 80):
        k, b = random.random(), random.choice(base).split()
        if k < 0.3:
            t = " ".join(b)
        elif k < 0.6:
            a = random.randint(0, 40)
            t = " ".join([word() for _ in range(random.randint(0, 30))] + b[a:a + random.randint(15, 40)] + [word()])
        elif k < 0.7:
            t = " ".join(["rep", "eat"] * random.randint(5, 40))
        else:
            t = "  ".join(word() for _ in range(random.randint(0, 50)))
        rows.append((None if i > 77 else i, t))
    return rows + [rows[10], rows[20]]


@pytest.mark.parametrize("flush,size,start", [(1_500_000, 20, 10), (50, 20, 5)])
def test_equals_brute_force(spark, rows, monkeypatch, flush, size, start):
    monkeypatch.setattr(substring, "FLUSH", flush)
    got = substring.remove_repeats(docs_of(spark, rows), size=size, start=start, digests=True).collect()
    assert sorted_rows(got) == sorted_rows(brute(rows, size))


def test_empty_table_and_sizes(spark):
    assert substring.remove_repeats(empty_docs(spark)).collect() == []
    with pytest.raises(ValueError):
        substring.remove_repeats(empty_docs(spark), size=20, start=6)


def test_kept_text(spark):
    passage = " ".join(f"w{i}" for i in range(25))
    got = {r["doc_id"]: r["kept"] for r in substring.remove_repeats(docs_of(spark, [(1, passage), (2, f"own\t{passage} words")])).collect()}
    assert got == {1: passage, 2: "own words"}
