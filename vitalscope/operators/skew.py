"""Joins whose key may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import SMALL_ROWS, is_small

HOT_SHARE = 0.001  # so at most 1 / HOT_SHARE keys are hot


def lookup_join(
    rows: DataFrame, lookup: DataFrame, key: str, how: str = "left", max_rows: int = SMALL_ROWS,
    bound: DataFrame | None = None,
) -> DataFrame:
    """Join ``rows`` to ``lookup``, which has one row per key, by ``key``.

    A small lookup is broadcast. A large one is shuffled, except for hot keys:
    a key with at least HOT_SHARE of the rows, of which there can be no more
    than 1 / HOT_SHARE, is served from a broadcast of just those lookup rows.
    ``bound`` is a table at least as long as ``lookup`` that is cheaper to count.
    """
    if is_small(lookup if bound is None else bound, max_rows):
        return rows.join(F.broadcast(lookup), key, how)
    counts = rows.groupBy(key).count()
    least = F.greatest(F.lit(2.0), counts.agg(F.sum("count")).scalar() * HOT_SHARE)
    hot = [
        r[0] for r in counts.filter((F.col("count") >= least) & F.col(key).isNotNull())
        .select(key).collect()
    ]
    if not hot:
        return rows.join(lookup, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    served = rows.filter(is_hot).join(F.broadcast(lookup.filter(is_hot)), key, how)
    return served.unionByName(rows.filter(~is_hot).join(lookup, key, how))
