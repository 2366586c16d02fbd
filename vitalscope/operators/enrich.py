"""Filling a column from a slow service: cache, retry only what failed, status counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..session import checkpoint_dir
from . import sampling
from .skew import lookup_join


def usable_cache(cache: DataFrame, text: str, value: str) -> DataFrame:
    """text_key, value: cached results that are not blank, one per text.

    Texts travel and are compared by digest, so long and often repeated texts
    cost 64 characters each and copies merge before the shuffle.
    """
    filled = cache.filter(F.trim(F.coalesce(F.col(value), F.lit(""))) != "")
    return filled.groupBy(F.sha2(text, 256).alias("text_key")).agg(F.max(value).alias(value))


def from_cache(rows: DataFrame, cache: DataFrame, text: str, value: str) -> DataFrame:
    """Rows with the cached value and a status: resumed or pending."""
    keyed = rows.withColumn("text_key", F.sha2(tx.as_text(F.col(text)), 256))
    filled = lookup_join(keyed, usable_cache(cache, text, value), "text_key", bound=cache)
    return filled.withColumn(
        "status", F.when(F.col(value).isNotNull(), "resumed").otherwise("pending")
    ).drop("text_key")


def pending_texts(filled: DataFrame, text: str) -> DataFrame:
    """Distinct texts that still need the service, with their number of rows;
    counting merges copies before anything moves."""
    return filled.filter("status = 'pending'").groupBy(text).agg(F.count("*").alias("n_rows"))


def call_service(
    pending: DataFrame, text: str, value: str, load: Callable[[], Callable[[list[str]], list]],
    batch_rows: int = 32, partitions: int | None = None,
) -> DataFrame:
    """Run a user function over pending texts inside the tasks.

    ``load`` runs once per partition and returns a function from texts to
    values, None for a failure. ``partitions`` bounds how many calls run at once.
    """
    if partitions:
        pending = pending.repartition(partitions)
    schema = f"`{text}` string, `{value}` string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = load()
        for frame in frames:
            for start in range(0, len(frame), batch_rows):
                texts = frame[text].iloc[start:start + batch_rows].tolist()
                try:
                    values = list(service(texts))
                except Exception:  # a failed batch is retried on the next run
                    values = [None] * len(texts)
                yield pd.DataFrame({text: texts, value: values})

    return pending.select(text).mapInPandas(run, schema)


def save_calls(
    pending: DataFrame, text: str, value: str, load, path: str, batch_rows: int = 32, commits: int = 16,
) -> DataFrame:
    """Call the service once for every pending text and save the values at ``path``.

    The texts go in ``commits`` parts by their digest, each committed before the next
    starts, so a job that dies loses one part. Values that are saved there already
    are not asked for again.
    """
    spark = pending.sparkSession
    schema = f"`{text}` string, `{value}` string"
    saved = lambda: spark.read.schema(schema).parquet(path)
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    waiting = f"{checkpoint_dir(spark).rstrip('/')}/pending-{uuid.uuid4().hex}"
    pending.select(text).join(
        usable_cache(saved(), text, value).select("text_key"), F.sha2(text, 256) == F.col("text_key"), "left_anti"
    ).write.parquet(waiting)
    texts = spark.read.schema(f"`{text}` string").parquet(waiting)
    for part in range(commits):
        own = texts.filter(F.pmod(F.xxhash64(text), F.lit(commits)) == part)
        call_service(own, text, value, load, batch_rows).filter(F.col(value).isNotNull()).write.mode("append").parquet(path)
    return saved()


def enrich(
    rows: DataFrame, cache: DataFrame, text: str, value: str, key: str, load,
    sample: int | None = None, seed: int = 42, batch_rows: int = 32, cache_path: str | None = None,
) -> DataFrame:
    """Rows with the value and status resumed, translated or failed.

    New results are saved before they are used, at ``cache_path`` or in the shared
    folder, so the service sees every text once; a run that dies is resumed from
    what it has saved at ``cache_path``.
    """
    if sample is not None:
        rows = sampling.sample_exactly(rows, key, sample, seed)
    filled = from_cache(rows, cache, text, value)
    path = cache_path or f"{checkpoint_dir(rows.sparkSession).rstrip('/')}/enriched-{uuid.uuid4().hex}"
    fresh = save_calls(pending_texts(filled, text), text, value, load, path, batch_rows)
    new = usable_cache(fresh, text, value).withColumnRenamed(value, "_new")
    return (
        lookup_join(
            filled.withColumn("text_key", F.sha2(tx.as_text(F.col(text)), 256)), new, "text_key"
        )
        .withColumn(
            "status",
            F.when(F.col("status") == "resumed", "resumed")
            .when(F.col("_new").isNotNull(), "translated")
            .otherwise("failed"),
        )
        .withColumn(value, F.coalesce(F.col(value), F.col("_new")))
        .drop("text_key", "_new")
    )


def status_counts(filled: DataFrame) -> DataFrame:
    return filled.agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}")
          for s in ("resumed", "pending", "translated", "failed")],
    )


def require_complete(filled: DataFrame) -> DataFrame:
    """The rows unchanged; an error when any row failed."""
    failed = filled.filter("status IN ('failed', 'pending')").count()
    if failed:
        raise ValueError(f"{failed} row(s) have no value; nothing was scored")
    return filled
