import random
import zlib

import pytest

from vitalscope.llm import common, quality, toxicity

from .helpers import LONG, docs_of, empty_docs


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_automaton_equals_edit_distance():
    lexicon = toxicity.Lexicon({"worthless": 1.0, "loser": 1.0, "clown": 1.0, "stupid": 1.0, "bad": 1.0}, {"veju": 2.0})
    random.seed(0)
    for _ in range(4000):
        letters = list(random.choice(list(lexicon.terms)))
        for _ in range(random.randint(0, 3)):
            i = random.randrange(len(letters) + 1)
            if random.random() < 0.5:
                letters.insert(i, random.choice("abcelorstw"))
            elif letters:
                letters.pop(min(i, len(letters) - 1))
        word = "".join(letters)
        want = any(edit_distance(word, t) <= lexicon.edits(len(t)) for t in lexicon.terms)
        assert (lexicon.match(word)[0] != 0) == want, word
    assert lexicon.match("vejuaire") == (2, 2.0)


def test_quotation_is_counted_apart():
    import pyarrow as pa

    lexicon = toxicity.Lexicon({"loser": 5.0}, {})
    texts = pa.array(['he said "you loser" and left', "you loser and left", ""], pa.large_string())
    f = toxicity.features(common.Vocabulary(texts), lexicon, 3)
    assert f[0, 3] > 0 and f[0, 0] == 0 and f[0, 4] <= 0
    assert f[1, 0] > 0 and f[1, 3] == 0 and f[1, 4] == 5.0
    assert not f[2].any()


@pytest.mark.parametrize("module,label,modulus,left", [(toxicity, "toxic", 5, 0), (quality, "quality", 3, 1)])
def test_held_out_accuracy(spark, folder, module, label, modulus, left):
    folder = folder.replace("0.001", "0.1")
    docs, labels = common.table(spark, folder, "documents"), common.table(spark, folder, "labels")
    rows = module.score(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert rows and all(zlib.crc32(str(r["doc_id"]).encode()) % modulus == left for r in rows)
    assert sum(r["predicted"] == r[label] for r in rows) > 0.97 * len(rows)
    assert sum(r["predicted"] for r in rows if r[label]) > 0.8 * sum(1 for r in rows if r[label])


def test_edge_rows(spark):
    good = " ".join(f"plain words number {i}." for i in range(30))
    bad = "JUNK!! ### JUNK!! ### " * 10 + "idiot clown"
    rows = [(i, good if i % 2 else bad) for i in range(60)] + [(1000, None), (1001, ""), (None, good), (1002, LONG), (1, good)]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame(
        [(i, i % 2, 1 - i % 2) for i in range(60)] + [(5, None, None), (7, 1, 0)], "doc_id long, quality int, toxic int"
    )
    for module, label in ((toxicity, "toxic"), (quality, "quality")):
        got = module.score(docs, labels).collect()
        assert len(got) == len(rows)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
        assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
        assert module.score(empty_docs(spark), labels).collect() == []
        none = module.score(docs, labels.filter("doc_id < 0")).collect()
        assert len(none) == len(rows) and {r["score"] for r in none} == {0.0}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= {1, 3, 5} and 0 not in {r["doc_id"] for r in kept.collect()}


def test_additive_model_learns_an_interaction():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (3000, 3))
    y = ((x[:, 0] > 0) != (x[:, 1] > 0)).astype(float)
    model = quality.Additive(x, y)
    assert {i for i, j, _ in model.pairs} | {j for i, j, _ in model.pairs} >= {0, 1}
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9


def test_misspellings_of_terms_that_a_stem_covers(spark):
    random.seed(7)
    ends = ["lichkeit", "lichsten", "lungen", "barkeit"]
    fill = lambda: " ".join(f"plain{random.randrange(300)}" for _ in range(6))
    rows = [(f"{fill()} ach{ends[i % 4]} {fill()}", 1) for i in range(240)] + [(f"{fill()} {fill()}", 0) for _ in range(240)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, label int").repartition(3))
    assert "ach" in lexicon.stems and set(lexicon.terms) >= {"ach" + e for e in ends}
    for end in ends:
        assert lexicon.match("ach" + end)[0] == 2
        assert lexicon.match("ahc" + end)[0] == lexicon.match("xch" + end)[0] == 3
    assert lexicon.match("zebra")[0] == 0


def test_quality_learns_from_every_labelled_row(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    docs = docs_of(spark, [(i, " ".join(rng.choice(["tree", "House", "12", "sea!"], 5 + i % 7))) for i in range(90)], clash=False)
    labels = spark.createDataFrame([(i, int(i % 7 < 3)) for i in range(90)], "doc_id long, quality int")
    seen, plain = [], quality.Additive.of_parts

    def watched(means):
        def ask(question):
            seen.append(means(lambda part: [np.array([float(len(part.x))])])[0][0])
            return means(question)
        return plain(ask)

    used = quality.training_rows(labels, "quality", 3, 1, None).count()
    monkeypatch.setattr(quality.Additive, "of_parts", watched)
    whole = {r["doc_id"]: r["score"] for r in quality.score(docs, labels).collect()}
    assert seen and set(seen) == {float(used)}
    # One part: the model is that of all rows at once, to the last digit.
    rows = quality.features(docs).join(quality.training_rows(labels, "quality", 3, 1, None), "doc_id").collect()
    model = quality.Additive(np.array([r["f"] for r in rows]), np.array([r["label"] > 0 for r in rows]))
    texts = {r["doc_id"]: r["f"] for r in quality.features(docs).collect()}
    assert whole == {i: float(model.score(np.array([f]))[0]) for i, f in texts.items()}
    # Parts of a few rows: all are asked, and labels that are too many to be sent give the same.
    monkeypatch.setattr(quality, "PART", 20)
    parts = quality.score(docs, labels).orderBy("doc_id").collect()
    monkeypatch.setattr(quality, "SENT", 10)
    assert quality.score(docs, labels).orderBy("doc_id").collect() == parts
    assert {r["doc_id"] for r in parts} == set(whole) and {r["score"] for r in parts} != set(whole.values())
    table = spark.createDataFrame([(i % 3, [float(i), 1.0], i % 2) for i in range(50)], "part int,f array<double>,label int")
    mean, ones = quality._means(table, 50)(lambda part: [part.x.mean(0), part.y.mean()[None]])
    np.testing.assert_allclose(mean, [24.5, 1.0])
    np.testing.assert_allclose(ones, [0.5])


def test_quality_blocks_of_texts_are_bounded(spark, monkeypatch):
    import pyarrow as pa

    sizes = []
    batch = pa.record_batch([pa.array(range(500)), pa.array(["some words here " * 20] * 499 + [None])], ["doc_id", "text"])
    monkeypatch.setattr(quality, "BLOCK", 4096)
    found = list(quality._slices([batch], 1))
    for rows, texts in found:
        sizes.append(sum(len(t) for t in texts.to_pylist()))
        assert [t or None for t in texts.to_pylist()] == rows.column(1).to_pylist()
    assert max(sizes) <= 4096 and sum(r.num_rows for r, _ in found) == 500
