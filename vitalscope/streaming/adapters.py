"""Streams through the same plans: scoring keeps no state, enrichment resumes
from what earlier micro-batches wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import enrich, scoring


def score_stream(bundle: scoring.Bundle, stream: DataFrame) -> DataFrame:
    """Score a streaming table; every step is row-local."""
    return scoring.score(bundle, stream)


def write_scored(
    bundle: scoring.Bundle, stream: DataFrame, path: str, checkpoint: str, **trigger
) -> DataStreamWriter:
    """Writer of a scored stream to parquet; start() it."""
    writer = score_stream(bundle, stream).writeStream.format("parquet").option("path", path)
    writer = writer.option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(**trigger) if trigger else writer


def enrich_stream(
    stream: DataFrame, text: str, value: str, key: str, load, cache_path: str, out_path: str,
    checkpoint: str, batch_rows: int = 32, **trigger,
) -> DataStreamWriter:
    """Enrich each micro-batch against the cache grown so far.

    Output is partitioned by batch number and overwritten on replay, so a batch
    repeated after a failure leaves its rows once.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = f"`{text}` string, `{value}` string"
        try:
            cache = spark.read.schema(schema).parquet(cache_path)
        except Exception as error:  # nothing cached before the first batch
            if "PATH_NOT_FOUND" not in str(error):
                raise
            cache = spark.createDataFrame([], schema)
        filled = enrich.enrich(
            batch, cache, text, value, key, load, batch_rows=batch_rows, cache_path=cache_path
        )
        filled.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger) if trigger else writer


def level_counts(scored: DataFrame) -> DataFrame:
    """Rows per predicted level, for a running total in complete mode."""
    return scored.groupBy("Predicted_Triage_Level").agg(F.count("*").alias("n"))
