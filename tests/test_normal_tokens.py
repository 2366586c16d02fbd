"""Normalized tokens in one look at a text against the stages one after the other."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vitalscope.functions import fuzzy, text as tx
from vitalscope.lexicon import Lexicon
from vitalscope.operators.normalize import Normalizer

TEXTS = ["er re the heart hārt", "breath brth hart heart heart", "", None, "in the\x1cend\x85the  THTH end", "is es is is", "re er er ou of of", "don't, won't", "es", "is"]


@pytest.mark.parametrize("rules,terms", [([], ["heart", "breath"]), ([("in the", "of the")], ["heart", "breath"]), ([], [])])
def test_equals_the_stages(spark, monkeypatch, rules, terms):
    monkeypatch.setattr(fuzzy, "PART_CHARS", 20)
    monkeypatch.setattr(fuzzy, "MEMORY_WORDS", 6)
    n = Normalizer(Lexicon(variants={"es": "ēs", "is": "ēs", "of": "ōf", "re": "ōf"}, rules=rules, fillers={"er": "re", "ou": "of"}, fuzzy_terms=terms))
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").coalesce(1)
    staged = df.withColumn("r", n.repaired_tokens(n.ruled_tokens(tx.as_text(F.col("t")))))
    staged = staged.withColumn("m", n.mapped_tokens(F.col("r"))).withColumn("x", tx.collapse_stutter(F.col("r"), F.col("m")))
    want = {r["i"]: r["x"] for r in staged.select("i", "x").collect()}
    assert {r["i"]: r["x"] for r in n.add_tokens(df, "t", "x").select("i", "x").collect()} == want


def test_a_word_is_looked_up_once_and_parts_are_bounded(monkeypatch):
    monkeypatch.setattr(fuzzy, "PART_CHARS", 10)
    asked = []
    normal = fuzzy.normal_tokens_udf(lambda words: [asked.append(w) for w in words], {"a": "b"}, {"b": "c"})
    got = normal.func(pa.array(["a b a", "b b x", "x a", None, "", "a" * 30]))
    # The c of b repeats that of a, which has become b as well: no stutter.
    assert got.to_pylist() == [["c", "c", "c"], ["c", "c", "x"], ["x", "c"], [], [], ["a" * 30]]
    assert asked == ["b", "b", "x", "a" * 30]


def test_normalizing_takes_no_interpreted_step_per_token(spark):
    df = spark.createDataFrame([("x",)], "t string")
    n = Normalizer(Lexicon(variants={"es": "ēs"}, fillers={"er": "re"}))
    plan = n.normalize(df, "t", "n")._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan and plan.count("ArrowEvalPython") == 1
