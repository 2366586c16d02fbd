"""Seeded splits, folds and samples with exact sizes.

Rows of a class are ordered by a digest of key and seed. The first digits of
the digest cut every class into ranges of that order; a row's rank is its rank
inside the range plus the sizes of the ranges before. No class, however large,
is ever sorted in one task, and the result does not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import small_rows
from .skew import lookup_join

RANGE_DIGITS = 3  # 16**3 ranges per class


def digest(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")))


def ranked(
    df: DataFrame, key: str, group: str | None, seed: int, out: str = "rank",
    size: str | None = None,
) -> DataFrame:
    """Add the 1-based rank of each row in the seeded order of its group, and
    with ``size`` the number of rows of the group."""
    group_col = F.col(group) if group else F.lit(0)
    marked = df.withColumn("_g", group_col).withColumn("_d", digest(F.col(key), seed)).withColumn(
        "_r", F.substring("_d", 1, RANGE_DIGITS)
    )
    sizes = marked.groupBy("_g", "_r").agg(F.count("*").alias("_n"))
    # At most 16**RANGE_DIGITS rows per group.
    whole = Window.partitionBy("_g")
    earlier = whole.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_g", "_r", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("_size"),
    )
    inside = Window.partitionBy("_g", "_r").orderBy("_d", key)
    # The window leaves the rows partitioned the way the join wants them.
    joined = marked.withColumn("_i", F.row_number().over(inside)).join(
        offsets, (marked["_g"].eqNullSafe(offsets["_g"])) & (marked["_r"] == offsets["_r"])
    ).drop(offsets["_g"], offsets["_r"])
    joined = joined.withColumn(out, F.col("_before") + F.col("_i"))
    if size is not None:
        joined = joined.withColumn(size, F.col("_size"))
    return joined.drop("_g", "_d", "_r", "_n", "_before", "_i", "_size")


def stratified_split(
    df: DataFrame, key: str, label: str, test_share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add is_test: the rounded share of each class, chosen by the seeded order."""
    return (
        ranked(df, key, label, seed, "_rank", "_class_rows")
        .withColumn("is_test", F.col("_rank") <= F.round(F.col("_class_rows") * test_share))
        .drop("_rank", "_class_rows")
    )


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Add fold 0..k-1, each class dealt out evenly."""
    return (
        ranked(df, key, label, seed, "_rank")
        .withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int"))
        .drop("_rank")
    )


def sample_exactly(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in seeded order, or all when there are fewer."""
    return df.orderBy(digest(F.col(key), seed), key).limit(n)


# Up to this many rows per group each task passes on its first ones only (a limit of Spark's own).
TOP_ROWS = 999


def sample_per_group(df: DataFrame, key: str, group: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows of each group in seeded order, or all of a smaller one.

    Every task keeps the first ``n`` of its rows per group, and only these are shuffled and ranked.
    """
    if n > TOP_ROWS:
        return ranked(df, key, group, seed, "_rank").filter(F.col("_rank") <= n).drop("_rank")
    order = Window.partitionBy(group).orderBy(digest(F.col(key), seed), key)
    return df.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n).drop("_rank")


def meaning_clusters(
    df: DataFrame, key: str, text: str, rules: dict[str, list[list[str]]], per_cluster: int = 10,
    seed: int = 42,
) -> DataFrame:
    """key, cluster: a seeded sample per rule; a row sampled for one rule is
    not available to later ones. Rules with too few rows are left out.

    A sample has ``per_cluster`` rows, so the taken keys travel as a literal.
    """
    taken: list = []
    chosen: list[tuple] = []
    for name, any_of in rules.items():
        matches = F.lit(False)
        for all_of in any_of:
            every = F.lit(True)
            for part in all_of:
                every = every & F.contains(F.col(text), F.lit(part))
            matches = matches | every
        free = df.filter(matches)
        if taken:
            free = free.filter(~F.col(key).isin(taken))
        keys = [r[0] for r in sample_exactly(free.select(key), key, per_cluster, seed).collect()]
        if len(keys) < per_cluster:
            continue
        taken += keys
        chosen += [(k, name) for k in keys]
    schema = f"{key} {dict(df.dtypes)[key]}, cluster string"
    return df.sparkSession.createDataFrame(chosen, schema)


def large_enough_groups(df: DataFrame, group: str, at_least: int) -> DataFrame:
    """Rows whose group has at least ``at_least`` rows."""
    big = df.groupBy(group).count().filter(F.col("count") >= at_least).select(group)
    return lookup_join(df, big, group, "left_semi")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """label, n, weight: rows / (classes * rows of the class)."""
    sizes = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total, classes = sizes.agg(F.sum("n")).scalar(), sizes.agg(F.count("*")).scalar()
    return sizes.withColumn("weight", total / (classes * F.col("n")))


def add_class_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Add the weight of each row's class. The class sizes are fetched once; a
    label with more classes than a small table holds is joined instead."""
    sizes = df.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_n"))
    rows = small_rows(sizes)
    if rows is None:
        weights = class_weights(df.withColumn("_l", F.col(label)), "_l").select(
            F.col("label").alias(label), F.col("weight").alias(out)
        )
        return lookup_join(df, weights, label, "inner")
    total = sum(r["_n"] for r in rows)
    cells = [(r["_l"], total / (len(rows) * r["_n"])) for r in rows]
    schema = f"`{label}` {dict(df.dtypes)[label]}, `{out}` double"
    return df.join(F.broadcast(df.sparkSession.createDataFrame(cells, schema)), label)
