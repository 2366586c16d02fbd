"""Readers: messy delimited files, clusters, vectors, word lists."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions import repair, text as tx
from ..operators.similarity import check_unique_members, vector_contract
from ..schemas import LABELLED, SCORING

# Windows-1252 characters of the bytes 0x80-0x9F that ISO-8859-1
# reads as controls, in byte order; five bytes are unassigned.
_CP1252_BYTES = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
_CP1252_CHARS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
_BOM = "\ufeff"


def inspect_text(spark: SparkSession, path: str) -> dict[tuple[str, bool], list[str]]:
    """The files of a path by encoding and by whether quoted cells run over several lines.

    One pass by the executors, one row per file: UTF-8 when every line is valid UTF-8,
    else ISO-8859-1. When every line has an even number of quotes no cell crosses a
    line end, and the file may be split for reading. Files without a line are left out.
    """
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    facts = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.bool_or(~F.is_valid_utf8("value")).alias("bad"), F.bool_or(quotes % 2 == 1).alias("crossing"),
    )
    out: dict[tuple[str, bool], list[str]] = {}
    for row in facts.orderBy("file").collect():
        out.setdefault(("ISO-8859-1" if row["bad"] else "UTF-8", row["crossing"]), []).append(unquote(row["file"]))
    return out


def detect_encoding(spark: SparkSession, path: str) -> str:
    """ISO-8859-1 where any file of the path is not UTF-8."""
    return max((e for e, _ in inspect_text(spark, path)), key=lambda e: e != "UTF-8", default="UTF-8")


def in_file_order(df: DataFrame, out: str = "row_id", first: int = 1) -> DataFrame:
    """Number the rows of a table read from files: by file name, then as they stand in it.

    A row's place in its file or split is known to the task that reads it; the splits' row
    counts, one row each, are added up before them. No row is sorted or shuffled. Call it on
    the table as read, before filters or joins.
    """
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    # The id holds the partition and the place in it; a split's rows follow each other.
    at = F.monotonically_increasing_id()
    placed = df.select("*", file.alias("_file"), start.alias("_start"), at.alias("_at"))
    splits = placed.groupBy("_file", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("_file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    named = placed.join(F.broadcast(offsets), ["_file", "_start"])
    return named.withColumn(out, F.col("_before") + F.col("_at") - F.col("_first") + first).drop(
        "_file", "_start", "_at", "_first", "_before")


def _cp1252(col: Column) -> Column:
    return F.translate(col, _CP1252_BYTES, _CP1252_CHARS)


def _typed(col: Column, kind: T.DataType) -> Column:
    """A cell as ``kind``; whole numbers written with a decimal point are integers too."""
    col = tx.strip(col) if not isinstance(kind, T.StringType) else col
    plain = col.try_cast(kind)
    if not isinstance(kind, T.IntegralType):
        return plain
    number = repair.finite_number(col)
    return F.coalesce(plain, F.when(number == F.floor(number), number).try_cast(kind))


def _read_group(spark: SparkSession, files: list[str], encoding: str, crossing: bool) -> DataFrame:
    """Files of one encoding, as text columns."""
    raw = spark.read.option("header", True).option("encoding", encoding).option(
        "multiLine", crossing
    ).option("escape", '"').csv(files)
    names = [c.lstrip(_BOM).removeprefix("\u00ef\u00bb\u00bf") for c in raw.columns]
    raw = raw.toDF(*names)
    if encoding != "UTF-8":
        raw = raw.select(*[_cp1252(F.col(f"`{c}`")).alias(c) for c in names])
    return raw


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None, encoding: str | None = None,
) -> DataFrame:
    """A CSV or TXT table with a header, every column as text unless a schema is given.

    Columns are matched by header name. Every file is read by its own encoding and quoting: one that
    is not UTF-8 as windows-1252, and only those with quoted line ends unsplit. A byte-order
    mark is dropped from the first header.
    """
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in ("csv", "txt"):
        raise ValueError(f"unsupported file type {suffix!r}; use csv or txt")
    groups = inspect_text(spark, path) or {("UTF-8", False): [path]}
    raw = None
    for (found, crossing), files in groups.items():
        part = _read_group(spark, files, encoding or found, crossing)
        raw = part if raw is None else raw.unionByName(part, allowMissingColumns=True)
    names = raw.columns
    if schema is None:
        return raw
    return raw.select(*[
        (_typed(F.col(f"`{f.name}`"), f.dataType) if f.name in names
         else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ])


def read_labelled(
    spark: SparkSession, path: str, text_column: str | None = None
) -> DataFrame:
    """The labelled record table from CSV or parquet; ``text_column`` replaces the text."""
    if path.rstrip("/").endswith((".csv", ".txt")):
        raw = read_table(spark, path)
    else:
        raw = spark.read.parquet(path)
    if text_column is not None:
        raw = raw.withColumn("Complaint_Text", F.col(text_column))
    return raw.select(*[
        (_typed(F.col(f.name).cast("string"), f.dataType) if f.name in raw.columns
         else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in LABELLED.fields
    ])


def read_scoring(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, SCORING)


def by_position(df: DataFrame, **positions: int) -> DataFrame:
    """Name columns by their position: ``by_position(df, text=3, label=11)``."""
    return df.select(*[F.col(f"`{df.columns[i]}`").alias(name) for name, i in positions.items()])


def read_clusters(spark: SparkSession, path: str, root: str | None = "clusters") -> DataFrame:
    """A JSON map of cluster to texts in long form: cluster, pos, text.

    A text listed twice, in one cluster or in two, is an error.
    """
    body = spark.read.text(path, wholetext=True)
    if root:
        body = body.select(F.get_json_object("value", f"$.{root}").alias("value"))
    clusters = body.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias(
        "cluster", "texts"
    ))
    return check_unique_members(
        clusters.select("cluster", F.posexplode("texts").alias("pos", "text"))
    )


def wide_clusters(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A sheet with one cluster per column in long form: cluster, text; blanks dropped."""
    columns = columns or df.columns
    long = df.unpivot([], columns, "cluster", "text")
    return long.filter(tx.strip(F.coalesce("text", F.lit(""))) != "")


def read_vectors(
    spark: SparkSession, path: str, key: str, vector: str, dim: int | None = None,
    expected: DataFrame | None = None,
) -> DataFrame:
    """A parquet table of vectors; an error when it breaks the vector contract."""
    vectors = spark.read.parquet(path).select(key, F.col(vector).cast("array<float>").alias(vector))
    facts = vector_contract(vectors, key, vector, expected, dim).first()
    if not facts["is_valid"]:
        raise ValueError(f"vector table {path} is not usable: {facts.asDict()}")
    return vectors


def read_stopwords(spark: SparkSession, path: str, preferred: str | None = None) -> DataFrame:
    """token: the list inside a stop-word report. A list beside a model goes
    first; without any file the list is empty."""
    for candidate in (preferred, path):
        if candidate is None:
            continue
        try:
            report = spark.read.option("multiLine", True).json(candidate)
        except Exception as error:  # only a missing file means "not learned yet"
            if "PATH_NOT_FOUND" not in str(error):
                raise
            continue
        return report.select(F.explode("stopwords").alias("token")).distinct()
    return spark.createDataFrame([], "token string")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """text: the lines of a file that are not blank."""
    return spark.read.text(path).select(tx.strip(F.col("value")).alias("text")).filter(F.col("text") != "")


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """variant, canonical: the spelling dictionary from a JSON map of canonical
    form to spellings."""
    body = spark.read.text(path, wholetext=True)
    pairs = body.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias(
        "canonical", "spellings"
    ))
    return pairs.select(F.explode("spellings").alias("variant"), "canonical")


def read_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Cluster rows and the OVERALL row of a saved evaluation."""
    table = spark.read.option("header", True).csv(path)
    return table.filter("cluster <> 'OVERALL'"), table.filter("cluster = 'OVERALL'")


def reference_corpus(clusters: DataFrame | None, records: DataFrame, text: str) -> DataFrame:
    """text: the clustered texts, or without them the distinct record texts."""
    if clusters is not None:
        return clusters.select(F.col("text"))
    return records.select(F.col(text).alias("text")).filter("text IS NOT NULL").distinct()
