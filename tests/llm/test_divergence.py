import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalscope.llm import divergence

from .helpers import LONG, sorted_rows

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=3, top=200):
    n, df, groups = collections.Counter(), collections.defaultdict(collections.Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        for w in words:
            n[lang, source, w] += 1
        df[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        sources = sorted(s for x, s in groups if x == lang)
        kept = [w for w, c in df[lang].items() if c >= least]
        share = {}
        for s in [*sources, None]:
            count = [sum(n[lang, x, w] for x in sources) if s is None else n[lang, s, w] for w in kept]
            share[s] = [1 + 10**9 * (c + 1) // (sum(count) + len(kept)) for c in count]
        f = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            pair = [(t, sum(map(f, share[s], share[t]))) for t in sources if t != s]
            term = [(w, f(p, q)) for w, p, q in zip(kept, share[s], share[None]) if n[lang, s, w] and p > q]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found) if part == "pair" or i < top]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    vocabulary = [f"{c}{d}" for c in "abcdeéß漢" for d in "xyzüñ"] + ["UPPER", "Ünder", "naïve"]
    out = [(None, "en", "s1"), ("", "en", "empty"), ("12 34 --", "en", "s2"), ("rare words only", "xx", "a"), ("other", "xx", "b"), (None, None, None)]
    out += [("one source alone", "one", "s")] * 3 + [(LONG, "en", "s0"), ("Hot word " * 500, "en", "s0")]
    for _ in range(400):
        lang = rng.choice(["en", "en", "en", "de", "", None])
        source = rng.choice(["s0", "s0", "s0", "s1", "s2", "s3", None])
        words = [vocabulary[min(int(rng.expovariate(0.15)), len(vocabulary) - 1)] for _ in range(rng.randint(0, 30))]
        out.append((rng.choice([" ", "-", "_1"]).join(words), lang, source))
    return out + out[:40]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    for name in ("term", "n", "chunk", "value", "g", "l", "t", "item"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(4)


@pytest.mark.parametrize("sources,held", [(128, 200_000), (1, 5)])
def test_equals_brute_force(spark, rows, monkeypatch, sources, held):
    monkeypatch.setattr(divergence, "SOURCES", sources)
    monkeypatch.setattr(divergence, "HELD", held)
    assert sorted_rows(divergence.audit(frame(spark, rows)).collect()) == sorted_rows(brute(rows))


def test_first_terms_only(spark, rows):
    got = divergence.audit(frame(spark, rows), least=1, top=4).collect()
    assert sorted_rows(got) == sorted_rows(brute(rows, 1, 4))


def test_shares_are_exact_for_large_counts(spark):
    pairs = [(0, 1), (10**13, 3 * 10**15 + 1), (5, 7), (2 * 10**15, 2 * 10**15 + 1), (10**9 * 3 - 1, 10**9 * 3)]
    want = [1 + 10**9 * (n + 1) // size for n, size in pairs]
    df = spark.createDataFrame(pairs, "n long, size long").select(divergence.share(F.col("n"), F.col("size")))
    assert [r[0] for r in df.collect()] == want
    n, size = np.array(pairs, np.int64).T
    assert divergence._shares(n, size).tolist() == want


def test_empty_table(spark):
    assert divergence.audit(frame(spark, []).limit(0)).collect() == []


def test_bitmaps_hold_every_count(spark, rows):
    counts = divergence.term_counts(frame(spark, rows))
    maps = divergence.level_bitmaps(divergence.kept_cells(counts)).collect()
    got = collections.Counter()
    for r in maps:
        got[r["lang"], r["source"]] += r["n"] * sum(b.bit_count() for b in r["bits"])
    cells = divergence.kept_cells(counts).groupBy("lang", "source").agg(F.sum("n").alias("n")).collect()
    assert got == {(r["lang"], r["source"]): r["n"] for r in cells}
