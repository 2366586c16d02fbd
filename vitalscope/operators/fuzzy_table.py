"""Match tables over the distinct words of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.fuzzy import CloseMatcher, match_udf


def close_matches(tokens: DataFrame, terms: list[str], cutoff: float = 0.8) -> DataFrame:
    """token, term, score: the closest term by matching-blocks ratio."""
    match = match_udf(CloseMatcher(terms, cutoff))
    return (
        tokens.select("token").distinct().withColumn("m", match("token"))
        .filter(F.col("m.term").isNotNull())
        .select("token", F.col("m.term").alias("term"), F.round("m.score", 6).alias("score"))
    )
