"""Writers: tables, reports and stamps. All write from the executors."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import similarity
from ..operators.stopwords import Thresholds, protected_hits, review_recommended, stopword_list

# Disclosure of data without a provenance record.
UNKNOWN_PROVENANCE = {
    "synthetic": "unknown",
    "disclosure": (
        "No provenance file accompanies this dataset; how it was produced is not recorded. "
        "Do not cite it as data of known origin."
    ),
}

MANIFEST = "number long, folder string, tables array<string>"


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, which CSV can hold."""
    return df.select(*[
        F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c)
        for c, t in df.dtypes
    ])


def write_csv(df: DataFrame, path: str) -> str:
    _flat(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def write_table(df: DataFrame, path: str) -> str:
    """CSV when the path ends so, else parquet."""
    if path.rstrip("/").endswith(".csv"):
        return write_csv(df, path)
    df.write.mode("overwrite").parquet(path)
    return path


def write_sheets(tables: dict[str, DataFrame], path: str, form: str = "csv") -> list[str]:
    """One sub-directory per named table."""
    return [write_table(df, f"{path}/{name}.{form}") for name, df in tables.items()]


def write_set(tables: dict[str, DataFrame], path: str) -> int:
    """Write several tables that belong together; readers see all of them or the former set.

    The tables go to a folder of their own first. One appended row of ``manifests`` then names it,
    and that row appears by a single commit. Returns the set's number. A run that ends before leaves
    the former set in force and an unnamed folder behind.
    """
    if not tables:
        raise ValueError("a set needs a table")
    spark = next(iter(tables.values())).sparkSession
    folder = f"set-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{path}/{folder}/{name}")
    number = 1 + max((r["number"] for r in _manifests(spark, path)), default=0)
    row = [(number, folder, sorted(tables))]
    spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifests")
    return number


def read_set(spark: SparkSession, path: str, number: int | None = None) -> dict[str, DataFrame]:
    """The tables of the last set, or of the given one."""
    rows = [r for r in _manifests(spark, path) if number is None or r["number"] == number]
    if not rows:
        raise FileNotFoundError(f"no such set in {path}")
    last = max(rows, key=lambda r: (r["number"], r["folder"]))
    return {name: spark.read.parquet(f"{path}/{last['folder']}/{name}") for name in last["tables"]}


def _manifests(spark: SparkSession, path: str) -> list:
    """One row per set."""
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/manifests").collect()
    except Exception as error:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return []


def write_target_reports(reports: dict[str, dict], path: str) -> int:
    """The tables of ``models.fit_target`` of every target as one set: ``<target>_report`` and so on."""
    names = ("report", "overall", "confusion", "predictions")
    return write_set({f"{target}_{n}": out[n] for target, out in reports.items() for n in names}, path)


def write_similarity_reports(
    df: DataFrame, key: str, vector: str, group: str, path: str, text: str | None = None, threshold: float = -1.0
) -> int:
    """Group statistics, pairs above ``threshold`` (below 0: all) and the rows themselves as one set."""
    shown = [key, group, *([text] if text else [])]
    return write_set({
        "groups": similarity.group_similarity(df, key, vector, group),
        "pairs": similarity.pairs_above(df, key, vector, group, threshold),
        "rows": df.select(*shown),
    }, path)


def stopword_report(
    stats: DataFrame, thresholds: Thresholds, watch_words, n_documents: int, classes: list
) -> DataFrame:
    """One row: thresholds, corpus facts and the three word lists.

    The lists are frequent tokens, bounded as explained in ``learned_words``.
    """
    def words(df: DataFrame):
        return F.coalesce(
            df.agg(F.sort_array(F.collect_list("token"))).scalar(), F.array().cast("array<string>")
        )

    one = stats.sparkSession.range(1)
    return one.select(
        F.struct(
            F.lit(thresholds.min_df).alias("min_df"),
            F.lit(thresholds.df_percentile).alias("df_percentile"),
            F.lit(thresholds.mi).alias("mi_threshold"),
            F.lit(thresholds.cramers_v).alias("cramers_v_threshold"),
            F.lit(thresholds.alpha).alias("alpha"),
        ).alias("thresholds"),
        F.struct(
            F.lit(n_documents).alias("n_documents"),
            stats.agg(F.count("*")).scalar().alias("n_tokens_tested"),
            F.array(*[F.lit(str(c)) for c in classes]).alias("triage_classes"),
        ).alias("corpus"),
        words(stopword_list(stats)).alias("stopwords"),
        words(protected_hits(stats)).alias("protected_from_removal"),
        words(review_recommended(stats, watch_words)).alias("review_recommended"),
    )


def write_stopword_report(
    stats: DataFrame, path: str, thresholds: Thresholds, watch_words, n_documents: int, classes: list
) -> None:
    """The report as JSON and the per-token statistics beside it."""
    stopword_report(stats, thresholds, watch_words, n_documents, classes).coalesce(1).write.mode(
        "overwrite"
    ).json(f"{path}/report")
    stats.write.mode("overwrite").parquet(f"{path}/token_statistics")


def write_metrics(tables: dict[str, DataFrame], path: str) -> None:
    """Small metric tables as JSON, one sub-directory each."""
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")


def dataset_stamp(spark: SparkSession, path: str, n_rows: int, n_classes: int) -> dict:
    """File name, digest, rows, classes and provenance of a training file.

    ``content_digest`` means the same at every size and is computed in splits: the
    SHA-256 of every line, the lines of a file summed up in four 60-bit parts and
    counted, and the SHA-256 over the sorted results of all files. It does not
    depend on the order of lines or on file names.
    """
    line = F.sha2("value", 256)
    part = lambda i: F.sum(F.conv(F.substring(line, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)"))
    files = spark.read.text(path).groupBy(F.input_file_name().alias("file")).agg(
        F.sha2(F.concat_ws(":", F.count("*"), *[part(i) for i in range(4)]), 256).alias("d")
    )
    digest = files.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("d")), ""), 256)).first()[0]
    try:
        text = spark.read.text(path + ".provenance.json", wholetext=True).first()["value"]
        provenance = json.loads(text)
    except Exception as error:  # only a missing file means "unknown"
        if "PATH_NOT_FOUND" not in str(error):
            raise
        provenance = UNKNOWN_PROVENANCE
    return {
        "file": os.path.basename(path.rstrip("/")), "rows": n_rows, "content_digest": digest,
        "n_classes": n_classes, "provenance": provenance,
    }


def run_date(df: DataFrame, out: str = "run_date") -> DataFrame:
    """Add today's date in UTC."""
    utc = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return df.withColumn(out, F.date_format(utc, "yyyy-MM-dd"))
