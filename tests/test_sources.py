import json

import pytest
from pyspark.sql import functions as F

from vitalscope.lexicon import REVIEW_WORDS
from vitalscope.operators import evaluation, stopwords as sw
from vitalscope.schemas import SCORING_COLUMNS
from vitalscope.sources import readers, writers


def put(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode("utf-8"))
    return str(path)


def test_utf8_with_mark_and_windows_bytes(spark, tmp_path):
    utf = put(tmp_path / "a.csv", b"\xef\xbb\xbf" + "Complaint_Text,Age\n“dárd”,12\n".encode())
    assert readers.detect_encoding(spark, utf) == "UTF-8"
    df = readers.read_table(spark, utf)
    assert df.columns == ["Complaint_Text", "Age"] and df.first()["Complaint_Text"] == "“dárd”"
    win = put(tmp_path / "b.csv", b"Complaint_Text,Age\n38\xb0C \x93dard\x94 \x80,12\n")
    assert readers.detect_encoding(spark, win) == "ISO-8859-1"
    assert readers.read_table(spark, win).first()["Complaint_Text"] == "38°C “dard” €"
    with pytest.raises(ValueError):
        readers.read_table(spark, str(tmp_path / "c.xlsx"))


def test_scoring_table_matches_by_name_and_pads(spark, tmp_path):
    path = put(tmp_path / "a.csv", 'Age,Complaint_Text\n"l10","dard, hai ""x"""\n')
    df = readers.read_scoring(spark, path)
    assert df.columns == SCORING_COLUMNS
    row = df.first()
    assert row["Age"] == "l10" and row["Complaint_Text"] == 'dard, hai "x"' and row["SpO2"] is None


def test_labelled_table_and_positions(spark, tmp_path):
    path = put(tmp_path / "a.csv", "Age,Gender,Complaint_Text,Triage_Level,English\n50,Male,dard,2,pain\nx,F,,3,y\n")
    df = readers.read_labelled(spark, path, "English")
    assert [r["Complaint_Text"] for r in df.collect()] == ["pain", "y"]
    assert [r["Age"] for r in df.collect()] == [50, None]
    raw = readers.read_table(spark, path)
    assert readers.by_position(raw, text=2, label=3).columns == ["text", "label"]


def test_clusters(spark, tmp_path):
    good = put(tmp_path / "a.json", json.dumps({"clusters": {"pain": ["a", "b"], "fever": ["c"]}}, indent=1))
    assert sorted(map(tuple, readers.read_clusters(spark, good).collect())) == [
        ("fever", 0, "c"), ("pain", 0, "a"), ("pain", 1, "b")]
    for clusters in ({"x": ["a"], "y": ["a"]}, {"x": ["a", "a"]}):
        bad = put(tmp_path / "b.json", json.dumps({"clusters": clusters}))
        with pytest.raises(ValueError):
            readers.read_clusters(spark, bad)


def test_wide_clusters_lines_and_variants(spark, tmp_path):
    wide = spark.createDataFrame([("a", "x"), ("b", None), (" ", "y")], "one string, two string")
    assert sorted(map(tuple, readers.wide_clusters(wide).collect())) == [
        ("one", "a"), ("one", "b"), ("two", "x"), ("two", "y")]
    lines = put(tmp_path / "l.txt", " dard \n\n  \nseena\n")
    assert [r["text"] for r in readers.read_lines(spark, lines).collect()] == ["dard", "seena"]
    variants = put(tmp_path / "v.json", json.dumps({"sēna": ["seena", "sina"]}))
    assert {tuple(r) for r in readers.read_variants(spark, variants).collect()} == {
        ("seena", "sēna"), ("sina", "sēna")}


def test_vectors(spark, tmp_path):
    path = str(tmp_path / "v")
    spark.createDataFrame([(1, [1.0, 2.0])], "id int, v array<double>").write.parquet(path)
    assert dict(readers.read_vectors(spark, path, "id", "v", 2).dtypes)["v"] == "array<float>"
    with pytest.raises(ValueError):
        readers.read_vectors(spark, path, "id", "v", 3)


def stats(spark):
    docs = [(i, ["hai", "nahi", "dard" if i % 2 else "ok"], i % 2) for i in range(10)]
    df = spark.createDataFrame(docs, "id int, tokens array<string>, label int")
    return sw.token_statistics(df, sw.Thresholds(df_percentile=0.0), protected=["ok"])


def test_stopword_report_round_trip(spark, tmp_path):
    path = str(tmp_path / "stop")
    writers.write_stopword_report(sw.with_p_value(stats(spark)), path, sw.Thresholds(), REVIEW_WORDS, 10, [0, 1])
    words = readers.read_stopwords(spark, path + "/report")
    assert sorted(r["token"] for r in words.collect()) == ["hai", "nahi"]
    report = json.loads(spark.read.text(path + "/report").first()["value"])
    assert report["review_recommended"] == ["nahi"] and report["corpus"]["n_tokens_tested"] == 4
    assert spark.read.parquet(path + "/token_statistics").count() == 4
    assert readers.read_stopwords(spark, str(tmp_path / "none")).count() == 0
    both = readers.read_stopwords(spark, path + "/report", preferred=str(tmp_path / "none"))
    assert both.count() == 2


def test_tables_sheets_and_metrics(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,\"b\"", [1, 2])], "i int, t string, a array<int>")
    csv = writers.write_table(df, str(tmp_path / "t.csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(csv).first()
    assert (back["i"], back["t"], back["a"]) == ("1", 'a,"b"', "[1,2]")
    paths = writers.write_sheets({"x": df, "y": df}, str(tmp_path / "book"), "parquet")
    assert [spark.read.parquet(p).count() for p in paths] == [1, 1]
    cells = spark.createDataFrame([(0, 0, 3), (0, 1, 1)], "label int, prediction int, n long")
    writers.write_metrics({"overall": evaluation.error_rates(cells), "confusion": cells}, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m" / "overall")).first()["accuracy"] == 75.0


def test_stamp(spark, tmp_path):
    path = put(tmp_path / "d.csv", "a\n1\n")
    stamp = writers.dataset_stamp(spark, path, 1, 4)
    assert len(stamp["content_digest"]) == 64
    assert stamp["provenance"]["synthetic"] == "unknown" and stamp["file"] == "d.csv"
    put(tmp_path / "d.csv.provenance.json", json.dumps({"synthetic": True}))
    assert writers.dataset_stamp(spark, path, 1, 4)["provenance"] == {"synthetic": True}


@pytest.mark.parametrize("split", ["128m", "16b"])
def test_stamp_does_not_depend_on_splits(spark, tmp_path, split):
    path = put(tmp_path / "d.csv", "".join(f"line {i}\n" for i in range(200)))
    want = writers.dataset_stamp(spark, path, 1, 4)["content_digest"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        assert writers.dataset_stamp(spark, path, 1, 4)["content_digest"] == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    other = put(tmp_path / "e.csv", "".join(f"line {i}\n" for i in range(1, 201)))
    assert writers.dataset_stamp(spark, other, 1, 4)["content_digest"] != want


def test_whole_numbers_with_a_point_are_integers(spark, tmp_path):
    path = put(tmp_path / "w.csv", "Age,Heart_Rate,Triage_Level\n72.0, 88.0,3.0\n1.5,x,2\n\t7 ,,inf\n")
    got = [(r["Age"], r["Heart_Rate"], r["Triage_Level"]) for r in readers.read_labelled(spark, path).collect()]
    assert [g[0] for g in got][0] == 72 and got[0][1] == 88 and got[0][2] == 3
    assert got[1][1] is None and got[1][2] == 2 and got[2][0] == 7 and got[2][2] is None


def test_results_split_and_run_date(spark, tmp_path):
    path = str(tmp_path / "r")
    spark.createDataFrame([("a", 1), ("OVERALL", 2)], "cluster string, n int").write.option("header", True).csv(path)
    rows, overall = readers.read_results(spark, path)
    assert rows.count() == 1 and overall.first()["n"] == "2"
    assert len(writers.run_date(spark.range(1)).first()["run_date"]) == 10
    records = spark.createDataFrame([("x",), ("x",), (None,)], "t string")
    assert readers.reference_corpus(None, records, "t").count() == 1
    clusters = spark.createDataFrame([("c", "y")], "cluster string, text string")
    assert readers.reference_corpus(clusters, records, "t").first()["text"] == "y"


def test_quoted_line_breaks_are_found(spark, tmp_path):
    plain = put(tmp_path / "p.csv", 'a,b\n"x ""y""",1\n')
    assert list(readers.inspect_text(spark, plain)) == [("UTF-8", False)]
    crossing = put(tmp_path / "c.csv", 'a,b\n"x\ny",1\n')
    assert list(readers.inspect_text(spark, crossing)) == [("UTF-8", True)]
    assert [tuple(r) for r in readers.read_table(spark, crossing).collect()] == [("x\ny", "1")]


def test_a_mixed_folder_reads_every_cell_right(spark, tmp_path):
    folder = tmp_path / "mixed set.csv"
    folder.mkdir()
    put(folder / "a.csv", 'name,n\nérable,1\n"two\nlines",2\n')
    (folder / "b 1.csv").write_bytes("name,n\ncafé €,3\n".encode("windows-1252"))
    put(folder / "c.csv", "\ufeffname,n\nplain,4\n")
    (folder / "d.csv").write_bytes('name,n\n"naïve\n""x""",5\n'.encode("windows-1252"))
    put(folder / "e.csv", "name,more\nwith more,6\n")
    put(folder / "f.csv", "")
    groups = readers.inspect_text(spark, str(folder))
    assert {k: len(v) for k, v in groups.items()} == {
        ("UTF-8", True): 1, ("ISO-8859-1", False): 1, ("UTF-8", False): 2, ("ISO-8859-1", True): 1}
    assert readers.detect_encoding(spark, str(folder)) == "ISO-8859-1"
    folder.joinpath("e.csv").unlink()  # files of a group share a header
    got = readers.read_table(spark, str(folder))
    assert sorted((r["n"], r["name"]) for r in got.collect()) == [
        ("1", "érable"), ("2", "two\nlines"), ("3", "café €"), ("4", "plain"), ("5", 'naïve\n"x"')]


def test_row_ids_follow_the_files(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(5000).repartitionByRange(7, "id").write.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4k", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = readers.in_file_order(spark.read.parquet(path), "no").collect()
            assert sorted(r["no"] for r in got) == list(range(1, 5001))
            assert all(r["no"] == r["id"] + 1 for r in got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    plan = readers.in_file_order(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_sets_are_seen_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "set")
    with pytest.raises(FileNotFoundError):
        writers.read_set(spark, path)
    first = {"report": spark.range(3), "overall": spark.range(1)}
    assert writers.write_set(first, path) == 1
    broken = spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("killed"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="killed"):
        writers.write_set({"report": spark.range(9), "overall": broken}, path)
    assert {n: df.count() for n, df in writers.read_set(spark, path).items()} == {"report": 3, "overall": 1}
    assert writers.write_set({"report": spark.range(5)}, path) == 2
    assert {n: df.count() for n, df in writers.read_set(spark, path).items()} == {"report": 5}
    assert set(writers.read_set(spark, path, 1)) == {"report", "overall"}


def test_report_sets(spark, tmp_path):
    path = str(tmp_path / "similar")
    rows = [(i, "ab"[i % 2], f"text {i}", [float(i % 3), 1.0, float(i)]) for i in range(8)]
    df = spark.createDataFrame(rows, "id int, dept string, text string, v array<double>")
    writers.write_similarity_reports(df, "id", "v", "dept", path, "text")
    got = writers.read_set(spark, path)
    assert set(got) == {"groups", "pairs", "rows"} and got["pairs"].count() == 2 * 6 and got["rows"].columns == ["id", "dept", "text"]
    from pyspark.ml.functions import array_to_vector

    from vitalscope.operators import models

    many = df.withColumn("id", F.explode(F.sequence(F.col("id") * 10, F.col("id") * 10 + 9))).withColumn("features", array_to_vector("v"))
    reports = {"dept": models.fit_target(many.drop("text"), "dept", "id")}
    writers.write_target_reports(reports, str(tmp_path / "targets"))
    assert set(writers.read_set(spark, str(tmp_path / "targets"))) == {f"dept_{n}" for n in ("report", "overall", "confusion", "predictions")}
