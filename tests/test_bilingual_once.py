"""The two-language preprocessor sends a text to one worker, once."""

from vitalscope.operators.bilingual import FIELDS, BilingualLexicon, BilingualPreprocessor


def test_one_look_at_a_text(spark):
    texts = [None, "", " \t", "hedache bukhaar  kamarr dard zzz", "severe sir dard hai aur chest mein khansi left"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    out = BilingualPreprocessor().process(df, "t")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan
    assert out.columns == ["id", "t", *FIELDS]
    rows = {r["id"]: r for r in out.collect()}
    assert all(rows[i][f] == "" for i in (0, 1, 2) for f in FIELDS)
    assert all(rows[i][f] is not None for i in (3, 4) for f in FIELDS)


def test_phrases_meet_what_the_phrases_before_them_left(spark):
    lexicon = BilingualLexicon(
        english=["pain"], helpers=["no"], roman={"sir": "head ache"}, stopwords=["hai"], misspellings={"penn": "pain  of"},
        phrases=[("", "all"), ("a b", "one"), ("xy", "two")], priority=["one", "head"], max_words=2)
    df = spark.createDataFrame([("no penn HAI xa by sir sir",)], "t string")
    row = BilingualPreprocessor(lexicon).process(df, "t").first()
    assert (row["english_portion"], row["roman_urdu_portion"]) == ("no", "penn hai xa by sir sir")
    assert row["corrected_roman_urdu"] == "pain  of xa by sir sir"
    assert row["mapped_from_roman"] == "all one two pain of head ache"
    assert row["mapped_english_representation"] == "no all one two pain of head ache"
    assert row["truncated_chief_complaint"] == "one pain"
