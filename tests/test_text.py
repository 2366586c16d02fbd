import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from vitalscope.functions import text as tx
from vitalscope.functions.lookup import WordMap, in_words
from vitalscope.lexicon import Lexicon
from vitalscope.operators.normalize import Normalizer


def one(spark, expr, *values):
    names = [f"c{i}" for i in range(len(values))]
    frame = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return frame.select(expr(*[F.col(n) for n in names]).alias("x")).first()["x"]


def test_clean_keeps_every_space_and_unicode_whitespace(spark):
    assert one(spark, tx.clean_text, "Loose,  Motion! 12 É") == "loose   motion      "


def test_letter_tokens_equal_clean_then_tokenize(spark):
    texts = ["Seena mein DARD!", "a1b2  c", "", " x y\x1cz", "É ß 漢字 ok", "123"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select(
        tx.letter_tokens(F.col("t")).alias("a"), tx.tokenize(tx.clean_text(F.col("t"))).alias("b")
    ).collect()
    assert all(r["a"] == r["b"] for r in out)
    expected = [re.sub(r"[^a-z\s]", " ", t.lower()).split() for t in texts]
    assert [r["b"] for r in out] == expected


def test_rules_apply_in_order_and_inside_words(spark):
    rules = [("thanda pasina", "sweating"), ("pasina", "sweat")]
    assert one(spark, lambda c: tx.apply_phrase_rules(c, rules), "thanda pasina pasinay") == "sweating sweaty"


def test_fillers_replace_whole_tokens_only(spark):
    n = Normalizer(Lexicon(rules=[], fillers={"hay": "hai"}))
    assert one(spark, n.ruled_tokens, "kandhay hay") == ["kandhay", "hai"]


def test_word_map_finds_every_entry(spark):
    mapping = {f"w{i}é": f"c{i}" for i in range(1500)}
    df = spark.createDataFrame([(k,) for k in mapping] + [("none",)], "w string")
    found = {r["w"]: r["x"] for r in df.select("w", WordMap(mapping).get(F.col("w")).alias("x")).collect()}
    assert found == {**mapping, "none": None}


def test_stutter_collapses_only_what_mapping_created(spark):
    n = Normalizer(Lexicon(rules=[], fillers={}, fuzzy_terms=[],
                           variants={"khana": "K", "khane": "K", "x": "K"}))
    texts = ["khana khane", "rukk rukk kar", "khana khana", "khana khane khana", "khane dard khana", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r["n"] for r in n.normalize(df, "t", "n").orderBy("i").collect()]
    assert got == ["K", "rukk rukk kar", "K K", "K", "K dard K", ""]


def test_remove_stopwords_never_leaves_nothing(spark):
    def cut(c):
        return tx.remove_stopwords(c, tx.tokenize(c), ["hai", "mein"])

    assert one(spark, cut, "dard hai  seena mein") == "dard seena"
    assert one(spark, cut, " hai  mein ") == " hai  mein "
    assert one(spark, lambda c: tx.remove_stopwords(c, tx.tokenize(c), []), " a  b ") == " a  b "


def test_empty_word_list_matches_nothing(spark):
    assert one(spark, lambda c: in_words(c, []), "x") is False


def word_grams(text):
    words = re.findall(r"(?u)\b\w\w+\b", text.lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def char_grams(text, low=2, high=4):
    grams = []
    for word in text.lower().split():
        padded = f" {word} "
        for n in range(low, high + 1):
            if len(padded) < n:
                break
            grams += [padded[i:i + n] for i in range(len(padded) - n + 1)]
    return grams


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="abé dz1_ ", max_size=20), min_size=1, max_size=6))
def test_ngrams_equal_brute_force(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select(
        tx.word_ngrams(tx.word_tokens(F.col("t"))).alias("w"), tx.char_ngrams(F.col("t")).alias("c")
    ).collect()
    for text, row in zip(texts, out):
        assert row["w"] == word_grams(text)
        assert row["c"] == char_grams(text)


def test_passage_prefix(spark):
    assert one(spark, tx.passage_prefix, "  ") == "passage: empty complaint"
    assert one(spark, tx.passage_prefix, "dard") == "passage: dard"


INVENTED = {"seena": "brúdi", "dard": "mólka", "sweating": "trīva"}


def test_explain_last_stage_is_the_preprocessed_text(spark):
    n = Normalizer(Lexicon(variants=INVENTED))
    df = spark.createDataFrame(
        [(1, "Seene mein  dard se, se thanda pasina hay"), (2, "12 !!")], "id int, t string")
    stages = n.explain(df, "id", "t", ["se", "mein"]).orderBy("id", "stage_no").collect()
    first = [r for r in stages if r["id"] == 1]
    assert [r["stage"] for r in first] == ["raw", "clean", "rules", "fuzzy", "diacritize", "stopwords"]
    assert first[0]["changed"] is False and first[0]["text"].startswith("Seene mein  dard")
    assert first[2]["text"] == "seene mein dard se se sweating hai"
    assert first[4]["text"] == "brúdi mein mólka se se trīva hai"
    assert first[5]["text"] == "brúdi mólka trīva hai" and first[5]["dropped"] == "mein se"
    full = n.preprocess(df, "t", ["se", "mein"], "full", "p").orderBy("id").collect()
    assert [r["p"] for r in full] == [first[5]["text"], ""]


def test_preprocess_modes(spark):
    df = spark.createDataFrame([("Dard hai seena", ), (None,)], "t string")
    n = Normalizer(Lexicon(variants=INVENTED))
    assert [r[0] for r in n.preprocess(df, "t", ["hai"], "raw", "p").select("p").collect()] == [
        "Dard hai seena", "unknown"]
    assert n.preprocess(df, "t", ["hai"], "stopwords_only", "p").first()["p"] == "Dard seena"
    assert n.preprocess(df, "t", ["hai"], "full", "p").first()["p"] == "mólka brúdi"


def test_normalization_is_idempotent_on_canonical_plain_words(spark):
    n = Normalizer(Lexicon(variants={"a1": "x", "aches": "pain"}, fuzzy_terms=["pain"]))
    df = spark.createDataFrame([("aches pain paain",)], "t string")
    once = n.normalize(df, "t", "n")
    twice = n.normalize(once, "n", "m").first()
    assert twice["n"] == twice["m"]


def test_gram_counts_equal_counting_all_grams(spark):
    from collections import Counter

    from vitalscope.functions.grams import gram_counts_udf

    texts = ["dard dard a", "", "seena é dard", None, "a a a"]
    vocabulary = sorted(set(g for t in texts if t for g in char_grams(t)))[::2]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    counts = gram_counts_udf(vocabulary)
    got = df.select("i", counts(tx.tokenize(F.col("t"))).alias("c")).orderBy("i").collect()
    for text, row in zip(texts, got):
        expected = Counter(char_grams(text or ""))
        assert row["c"] == [float(expected[g]) for g in vocabulary]
