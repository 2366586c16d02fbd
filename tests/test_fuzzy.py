import difflib
import random

import pytest
from pyspark.sql import functions as F

from vitalscope.functions.fuzzy import CloseMatcher, TermMatcher, indel_ratio, repair_tokens_udf
from vitalscope.lexicon import FUZZY_TERMS, Lexicon
from vitalscope.operators.bilingual import BilingualPreprocessor
from vitalscope.operators.normalize import Normalizer


def best_by_hand(word, terms, threshold=80.0):
    best = None
    for term in terms:
        score = indel_ratio(word, term)
        if score >= threshold and (best is None or score > best[1]):
            best = (term, score)
    return best


def words(n, seed=1):
    rnd = random.Random(seed)
    made = []
    for _ in range(n):
        base = list(rnd.choice(FUZZY_TERMS))
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(base))
            base[at:at + rnd.randint(0, 1)] = rnd.choice(["a", "h", "", "o", "é"])
            base = base or ["a"]
        made.append("".join(base))
    return made


def test_ratio_is_by_common_subsequence():
    assert indel_ratio("seene", "seena") == pytest.approx(80.0)
    assert indel_ratio("chaar", "chakkar") == pytest.approx(100 * 10 / 12)


def test_pruning_loses_no_match():
    found = TermMatcher(FUZZY_TERMS)(words(400))
    assert found == [best_by_hand(w, FUZZY_TERMS) if len(w) >= 3 else None for w in words(400)]


def test_first_term_wins_ties_and_guards_hold():
    matcher = TermMatcher(["abcd", "abce"], 80.0, {"abcx"})
    assert matcher(["abc", "abcx", "ab"])[0][0] == "abcd"
    assert matcher(["abcx", "ab"]) == [None, None]


def test_close_match_equals_standard_library():
    terms = ["headache", "fever", "cough", "cold", "chest", "stomach", "vomiting"]
    for word, found in zip(words(300, 7), CloseMatcher(terms, 0.6)(words(300, 7))):
        best = difflib.get_close_matches(word, terms, 1, 0.6)
        assert (found[0] if found else None) == (best[0] if best else None)


def test_repair_keeps_shape_nulls_and_empties(spark):
    repair = repair_tokens_udf(TermMatcher(FUZZY_TERMS))
    df = spark.createDataFrame(
        [(1, ["seene", "xx"]), (2, []), (3, None), (4, ["seene"])], "i int, t array<string>"
    ).coalesce(1)
    got = {r["i"]: r["x"] for r in df.select("i", repair(F.col("t")).alias("x")).collect()}
    assert got == {1: ["seena", "xx"], 2: [], 3: None, 4: ["seena"]}


def test_repair_skips_known_and_protected_words(spark):
    n = Normalizer(Lexicon(variants={"sina": "sēna"}))
    df = spark.createDataFrame([("sina par hoon chaar seeena",)], "t string")
    assert n.normalize(df, "t", "n").first()["n"] == "sēna par hoon chaar seena"


def test_repair_table(spark):
    df = spark.createDataFrame([("seeena",), ("seeena",), ("zzz",)], "token string")
    assert [tuple(r) for r in Normalizer().repairs(df).collect()] == [
        ("seeena", "seena", pytest.approx(1000 / 11))]


def bilingual(spark, text):
    return BilingualPreprocessor().process(spark.createDataFrame([(text,)], "t string"), "t").first()


def test_bilingual_steps(spark):
    row = bilingual(spark, "mujhe severe sir dard hai aur chest mein khansi left")
    assert row["english_portion"] == "severe chest left"
    assert row["roman_urdu_portion"] == "mujhe sir dard hai aur mein khansi"
    assert row["roman_without_stopwords"] == "sir dard khansi"
    assert row["mapped_from_roman"] == "headache cough"
    assert row["mapped_english_representation"] == "severe chest left headache cough"
    assert row["truncated_chief_complaint"] == "severe chest headache cough"


def test_bilingual_misspellings_phrases_and_fallback(spark):
    row = bilingual(spark, "hedache bukhaar kamarr dard zzz")
    assert row["corrected_roman_urdu"] == "headache bukhar kamar dard zzz"
    # The phrase comes first and leaves the rest of the text.
    assert row["mapped_from_roman"] == "back pain headache fever zzz"
    assert row["truncated_chief_complaint"] == "back pain headache fever"
    assert bilingual(spark, "zzz yyy")["truncated_chief_complaint"] == "zzz yyy"
    assert bilingual(spark, "")["truncated_chief_complaint"] == ""


def test_repair_looks_at_bounded_parts_of_a_batch(monkeypatch):
    import pyarrow as pa

    from vitalscope.functions import fuzzy

    monkeypatch.setattr(fuzzy, "PART_TOKENS", 10)
    asked = []
    repair = fuzzy.repair_tokens_udf(lambda words: [asked.append(len(words)) or (f"{w}!", 100.0) if i == 0 else None for i, w in enumerate(words)])
    tokens = pa.array([[f"w{i}", f"x{i}"] for i in range(40)] + [None, []] + [[f"y{i}" for i in range(30)]], pa.list_(pa.string()))
    got = repair.func(tokens)
    assert max(asked[:-1]) <= 10 and asked[-1] == 30
    assert [len(r) if r is not None else None for r in got.to_pylist()] == [2] * 40 + [None, 0, 30]
    assert got.to_pylist()[0] == ["w0!", "x0"] and got.to_pylist()[-1][0] == "y0!"
