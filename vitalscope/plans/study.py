"""The embedding-effectiveness study over one clustered vector table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import similarity
from ..session import checkpointed


def run(
    clusters: DataFrame, key: str, vector: str, cluster: str, pool: DataFrame | None = None,
    threshold: float = similarity.THRESHOLD, encoder: str = "", preprocessing: str = "",
    with_pairs: bool = True,
) -> dict[str, DataFrame]:
    """summary (clusters and OVERALL), pairs and neighbours, rounded for reports."""
    by_cluster = checkpointed(similarity.cluster_summary(clusters, key, vector, cluster, threshold))
    apart = similarity.separation(clusters, key, vector, cluster)
    neighbours = similarity.nearest_closed(clusters, key, vector, cluster)
    if pool is not None:
        neighbours = similarity.nearest_open(neighbours, clusters, pool, key, vector)
    neighbours = checkpointed(neighbours)
    efficiency = similarity.neighbour_efficiency(neighbours)
    named = by_cluster.withColumn("cluster", F.col("cluster").cast("string"))
    overall = similarity.overall_row(named)
    fact = apart.first()
    found = efficiency.first().asDict()
    dim = clusters.select(F.max(F.size(vector))).first()[0]
    overall = (
        overall.withColumn("across_cluster_similarity", F.lit(fact["across_mean"]).cast("double"))
        .withColumn("separation_gap", F.lit(fact["separation_gap"]).cast("double"))
        .withColumn("nn_efficiency_closed_pool_pct", F.lit(found["efficiency_closed_pct"]))
        .withColumn(
            "nn_efficiency_open_pool_pct", F.lit(found.get("efficiency_open_pct")).cast("double")
        )
        .withColumn("embedding_model", F.lit(encoder))
        .withColumn("embedding_dim", F.lit(dim))
        .withColumn("preprocessing", F.lit(preprocessing))
    )
    summary = named.unionByName(overall, allowMissingColumns=True)
    places = {
        "mean_cosine_similarity": 4, "min_cosine_similarity": 4, "max_cosine_similarity": 4,
        "mean_pearson_correlation": 4, "mean_euclidean_distance": 4, "pct_above": 1,
        "across_cluster_similarity": 4, "separation_gap": 4, "nn_efficiency_closed_pool_pct": 1,
        "nn_efficiency_open_pool_pct": 1,
    }
    summary = summary.select(*[
        F.round(c, places[c]).alias(c) if c in places else F.col(c) for c in summary.columns
    ]).withColumnRenamed("pairs_above", f"pairs_above_{threshold}").withColumnRenamed(
        "pct_above", f"pct_above_{threshold}"
    )
    out = {"summary": summary, "neighbours": neighbours.withColumn(
        "similarity", F.round("similarity", 4))}
    if with_pairs:
        out["pairs"] = similarity.pairs_above(clusters, key, vector, cluster, threshold)
    return out
