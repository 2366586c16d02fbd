"""How well vectors keep meanings together: pairs, separation, neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from ..functions import vectors as vx
from .pivots import CELL_ROWS, nearest
from .tiles import DIGITS, Tile, centred_units, over_tiles, self_tiles, units

# Fixed value: strictly above this a pair counts as seen as similar.
THRESHOLD = 0.5
# Documented drift a re-measured pair may show.
DRIFT_TOLERANCE = 0.02


def _distances(tile: Tile, rows: slice) -> np.ndarray:
    x, y = tile.x[rows], tile.y
    square = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T)
    gaps = np.sqrt(np.maximum(square, 0.0))
    # The short form cancels for near copies; those few are taken exactly.
    for i, j in zip(*np.nonzero(square < 1e-6 * ((x * x).sum(1)[:, None] + 1e-300))):
        gaps[i, j] = np.linalg.norm(x[i] - y[j])
    return gaps


def _clipped(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.clip(x @ y.T, 0.0, 1.0)


def pairs_above(
    df: DataFrame, key: str, vector: str, cluster: str, threshold: float = THRESHOLD,
    block_rows: int = 4096,
) -> DataFrame:
    """Pairs inside a cluster whose clipped cosine is strictly above ``threshold``.

    cluster, id_a, id_b, cosine_similarity, pearson_correlation, euclidean_distance.
    Pairs at or below the threshold never leave their tile; ``cluster_summary``
    counts them. A threshold below 0 lists every pair.
    """
    key_type = dict(df.dtypes)[key]
    cluster_type = dict(df.dtypes)[cluster]
    schema = (
        f"cluster {cluster_type},id_a {key_type},id_b {key_type},cosine_similarity double,"
        "pearson_correlation double,euclidean_distance double"
    )

    def pairs(tile: Tile) -> pd.DataFrame:
        ux, uy = units(tile.x), units(tile.y)
        px, py = centred_units(tile.x), centred_units(tile.y)
        left, right = tile.left["key"].to_numpy(), tile.right["key"].to_numpy()
        parts = []
        for rows in tile.stripes():
            sims = _clipped(ux[rows], uy)
            i, j = np.nonzero((sims > threshold) & tile.upper(rows))
            corr = np.einsum("ij,ij->i", px[rows][i], py[j])
            gaps = np.linalg.norm(tile.x[rows][i] - tile.y[j], axis=1)
            a, b = left[rows][i], right[j]
            parts.append(pd.DataFrame({
                "cluster": tile.group, "id_a": np.minimum(a, b), "id_b": np.maximum(a, b),
                "cosine_similarity": sims[i, j], "pearson_correlation": corr,
                "euclidean_distance": gaps,
            }))
        return pd.concat(parts)

    tiles = self_tiles(df, key, vector, group=cluster, block_rows=block_rows)
    return over_tiles(tiles, pairs, schema)


def _pair_sums(df, key, vector, cluster, threshold, block_rows) -> DataFrame:
    """Sums over the pairs of each cluster, one row per cluster."""
    cluster_type = dict(df.dtypes)[cluster]
    schema = (
        f"cluster {cluster_type},n long,s_cos double,lo double,hi double,s_corr double,"
        "s_dist double,above long"
    )

    def sums(tile: Tile) -> pd.DataFrame:
        ux, uy = units(tile.x), units(tile.y)
        px, py = centred_units(tile.x), centred_units(tile.y)
        n = above = 0
        s_cos = s_corr = s_dist = 0.0
        lo, hi = np.inf, -np.inf
        for rows in tile.stripes():
            use = tile.upper(rows)
            if not use.any():
                continue
            sims = _clipped(ux[rows], uy)[use]
            n += sims.size
            s_cos += sims.sum()
            lo, hi = min(lo, sims.min()), max(hi, sims.max())
            above += int((sims > threshold).sum())
            s_corr += (px[rows] @ py.T)[use].sum()
            s_dist += _distances(tile, rows)[use].sum()
        if n == 0:
            return pd.DataFrame(columns=[p.split()[0] for p in schema.split(",")])
        return pd.DataFrame([[tile.group, n, s_cos, lo, hi, s_corr, s_dist, above]],
                            columns=[p.split()[0] for p in schema.split(",")])

    tiles = self_tiles(df, key, vector, group=cluster, block_rows=block_rows)
    return over_tiles(tiles, sums, schema).groupBy("cluster").agg(
        F.sum("n").alias("n_pairs"), F.sum("s_cos").alias("s_cos"), F.min("lo").alias("lo"),
        F.max("hi").alias("hi"), F.sum("s_corr").alias("s_corr"), F.sum("s_dist").alias("s_dist"),
        F.sum("above").alias("above"),
    )


def cluster_summary(
    df: DataFrame, key: str, vector: str, cluster: str, threshold: float = THRESHOLD,
    block_rows: int = 4096,
) -> DataFrame:
    """Per cluster: counts, mean/min/max cosine, mean correlation and distance, pass rate.

    Unrounded. A cluster of one row has no pairs: 0 pairs, null means, 0 pass rate.
    """
    counts = df.groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("n_complaints"))
    sums = _pair_sums(df, key, vector, cluster, threshold, block_rows)
    n = F.col("n_pairs")
    return counts.join(sums, "cluster", "left").select(
        "cluster",
        "n_complaints",
        F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"),
        (F.col("s_cos") / n).alias("mean_cosine_similarity"),
        F.col("lo").alias("min_cosine_similarity"),
        F.col("hi").alias("max_cosine_similarity"),
        (F.col("s_corr") / n).alias("mean_pearson_correlation"),
        (F.col("s_dist") / n).alias("mean_euclidean_distance"),
        F.coalesce("above", F.lit(0)).alias("pairs_above"),
        F.coalesce(100.0 * F.col("above") / n, F.lit(0.0)).alias("pct_above"),
    )


def overall_row(summary: DataFrame) -> DataFrame:
    """The OVERALL row: cosine over all pairs, correlation and distance as the
    mean of the rounded cluster means."""
    n = F.sum("n_pairs")
    return summary.agg(
        F.lit("OVERALL").alias("cluster"),
        F.sum("n_complaints").alias("n_complaints"),
        n.alias("n_pairs"),
        (F.sum(F.col("mean_cosine_similarity") * F.col("n_pairs")) / n)
        .alias("mean_cosine_similarity"),
        F.min(F.round("min_cosine_similarity", 4)).alias("min_cosine_similarity"),
        F.max(F.round("max_cosine_similarity", 4)).alias("max_cosine_similarity"),
        F.avg(F.round("mean_pearson_correlation", 4)).alias("mean_pearson_correlation"),
        F.avg(F.round("mean_euclidean_distance", 4)).alias("mean_euclidean_distance"),
        F.sum("pairs_above").alias("pairs_above"),
        (100.0 * F.sum("pairs_above") / n).alias("pct_above"),
    )


def separation(
    df: DataFrame, key: str, vector: str, cluster: str, clip: bool = True, block_rows: int = 4096,
    digits: int = 4,
) -> DataFrame:
    """One row: number, mean, median, min and max of the within- and across-cluster
    similarities and the gap between the means.

    Tiles send sums per similarity at ``digits`` places, so medians are exact at that
    precision and a tile sends at most 4 * 10**digits + 2 rows.
    """
    scale = 10**digits

    def sums(tile: Tile) -> pd.DataFrame:
        ux, uy = units(tile.x), units(tile.y)
        lx, ly = tile.left["c"].to_numpy(), tile.right["c"].to_numpy()
        n, s = np.zeros((2, 2 * scale + 1), np.int64), np.zeros((2, 2 * scale + 1))
        ends = np.array([[np.inf, -np.inf], [np.inf, -np.inf]])
        for rows in tile.stripes():
            sims = ux[rows] @ uy.T
            if clip:
                sims = np.clip(sims, 0.0, 1.0)
            use, equal = tile.upper(rows), lx[rows][:, None] == ly[None, :]
            for same, mask in ((1, use & equal), (0, use & ~equal)):
                found = sims[mask]
                if found.size:
                    place = (np.clip(np.round(found, digits), -1.0, 1.0) * scale).round().astype(np.int64) + scale
                    n[same] += np.bincount(place, minlength=2 * scale + 1)
                    s[same] += np.bincount(place, found, 2 * scale + 1)
                    ends[same] = min(ends[same][0], found.min()), max(ends[same][1], found.max())
        same, place = np.nonzero(n)
        return pd.DataFrame({
            "same": same.astype(bool), "at": (place - scale) / scale, "n": n[same, place], "s": s[same, place],
            "lo": ends[same, 0], "hi": ends[same, 1],
        })

    tiles = self_tiles(
        df.withColumn("c", F.col(cluster)), key, vector, keep=("c",), block_rows=block_rows
    )
    parts = over_tiles(tiles, sums, "same boolean,at double,n long,s double,lo double,hi double")
    places = parts.groupBy("same", "at").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    same, other = F.col("same"), ~F.col("same")

    def mean(cond):
        return F.sum(F.when(cond, F.col("s"))) / F.sum(F.when(cond, F.col("n")))

    def median(cond):
        return F.percentile(F.when(cond, F.col("at")), 0.5, F.when(cond, F.col("n")).otherwise(F.lit(0)))

    return places.agg(
        F.coalesce(F.sum(F.when(same, F.col("n"))), F.lit(0)).alias("within_pairs"),
        F.coalesce(F.sum(F.when(other, F.col("n"))), F.lit(0)).alias("across_pairs"),
        mean(same).alias("within_mean"),
        mean(other).alias("across_mean"),
        median(same).alias("within_median"),
        median(other).alias("across_median"),
        F.min(F.when(same, F.col("lo"))).alias("within_min"),
        F.max(F.when(same, F.col("hi"))).alias("within_max"),
        F.min(F.when(other, F.col("lo"))).alias("across_min"),
        F.max(F.when(other, F.col("hi"))).alias("across_max"),
        (mean(same) - mean(other)).alias("separation_gap"),
    )


def group_similarity(
    df: DataFrame, key: str, vector: str, group: str, digits: int = 4, block_rows: int = 4096
) -> DataFrame:
    """Per group: rows, pairs and mean, median, min, max cosine of its pairs.

    Groups of one row keep nulls. Tiles send histograms of the similarities
    rounded to ``digits`` places, so the median is exact at that precision and
    a tile sends at most 2 * 10**digits + 1 rows.
    """
    group_type = dict(df.dtypes)[group]
    schema = f"group {group_type},similarity double,n long,s double"

    def histogram(tile: Tile) -> pd.DataFrame:
        ux, uy = units(tile.x), units(tile.y)
        counts = []
        for rows in tile.stripes():
            sims = (ux[rows] @ uy.T)[tile.upper(rows)]
            cells = pd.DataFrame({"similarity": np.round(sims, digits) + 0.0, "s": sims})
            counts.append(cells.groupby("similarity").agg(n=("s", "size"), s=("s", "sum")))
        merged = pd.concat(counts).groupby(level=0).sum().reset_index()
        merged.insert(0, "group", tile.group)
        return merged[["group", "similarity", "n", "s"]]

    counts = df.groupBy(F.col(group).alias("group")).agg(F.count("*").alias("n_rows"))
    tiles = self_tiles(df, key, vector, group=group, block_rows=block_rows)
    stats = (
        over_tiles(tiles, histogram, schema)
        .groupBy("group", "similarity")
        .agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        .groupBy("group")
        .agg(
            F.sum("n").alias("n_pairs"),
            (F.sum("s") / F.sum("n")).alias("mean_similarity"),
            F.percentile("similarity", 0.5, F.col("n")).alias("median_similarity"),
            F.min("similarity").alias("min_similarity"),
            F.max("similarity").alias("max_similarity"),
        )
    )
    return counts.join(stats, "group", "left").withColumn(
        "n_pairs", F.coalesce("n_pairs", F.lit(0))
    )


def arm_summary(
    df: DataFrame, key: str, vector: str, cluster: str, threshold: float = THRESHOLD,
    block_rows: int = 4096,
) -> DataFrame:
    """Per cluster: within and across mean (unclipped), gap, pass rate.

    Sums of dot products are dot products of sums, so the means need one
    vector sum per cluster; only the pass rate looks at pairs.
    """
    unit_rows = df.select(
        F.col(cluster).alias("cluster"), vx.unit(F.col(vector)).alias("u")
    ).withColumn("square", vx.dot(F.col("u"), F.col("u")))
    sums = unit_rows.groupBy("cluster").agg(
        F.count("*").cast("double").alias("n"),
        F.sum("square").alias("square"),
        vector_to_array(Summarizer.sum(array_to_vector("u"))).alias("v"),
    )
    everything = unit_rows.agg(
        F.count("*").cast("double").alias("all_n"),
        vector_to_array(Summarizer.sum(array_to_vector("u"))).alias("all_v"),
    )
    whole = everything.select(F.struct("all_n", "all_v")).scalar()
    n, v = F.col("n"), F.col("v")
    own = vx.dot(v, v)
    means = sums.withColumn("whole", whole).select(
        "cluster",
        (n * (n - 1) / 2).cast("long").alias("n_pairs"),
        ((own - F.col("square")) / F.nullif(n * (n - 1), F.lit(0.0))).alias("within"),
        ((vx.dot(v, F.col("whole.all_v")) - own)
         / F.nullif(n * (F.col("whole.all_n") - n), F.lit(0.0))).alias("across"),
    )
    above = over_tiles(
        self_tiles(df, key, vector, group=cluster, block_rows=block_rows),
        lambda tile: pd.DataFrame([[tile.group, _count_above(tile, threshold)]],
                                  columns=["cluster", "above"]),
        f"cluster {dict(df.dtypes)[cluster]},above long",
    ).groupBy("cluster").agg(F.sum("above").alias("above"))
    return means.join(above, "cluster", "left").select(
        "cluster",
        "within",
        "across",
        (F.col("within") - F.col("across")).alias("gap"),
        (100.0 * F.col("above") / F.nullif("n_pairs", F.lit(0))).alias("pass_rate"),
        "n_pairs",
    )


def _count_above(tile: Tile, threshold: float) -> int:
    ux, uy = units(tile.x), units(tile.y)
    return sum(
        int(((ux[rows] @ uy.T > threshold) & tile.upper(rows)).sum()) for rows in tile.stripes()
    )


def compare_arms(left: DataFrame, right: DataFrame, names=("a", "b")) -> DataFrame:
    """Two arm summaries side by side, with the change of the gap."""
    a, b = names
    columns = ["within", "across", "gap", "pass_rate"]
    wide = left.select("cluster", "n_pairs", *[F.col(c).alias(f"{c}_{a}") for c in columns]).join(
        right.select("cluster", *[F.col(c).alias(f"{c}_{b}") for c in columns]), "cluster"
    )
    return wide.withColumn("gap_change", F.col(f"gap_{b}") - F.col(f"gap_{a}"))


def nearest_closed(
    df: DataFrame, key: str, vector: str, cluster: str, block_rows: int = CELL_ROWS
) -> DataFrame:
    """Each row's most similar other row: key, cluster, neighbour, similarity, hit.

    Ties go to the smallest key. Clusters travel with the corpus rows, so a row that
    is the neighbour of very many others is never a join key. A row is compared
    only with cells that can hold its neighbour (``pivots``).
    """
    found = nearest(
        df.select(F.col(key).alias("key"), F.col(cluster).alias("true_cluster"), F.col(vector).alias("v")),
        df.select(F.col(key).alias("key"), F.col(cluster).alias("c"), F.col(vector).alias("v")),
        "key", "v", 1, "c", skip_own=True, cell_rows=block_rows,
    ).filter("size(best) > 0")
    best = F.col("best")[0]
    return found.select(
        "key", "true_cluster", best["key"].alias("neighbour"), best["c"].alias("neighbour_cluster"),
        (-best["minus"]).alias("similarity"), (F.col("true_cluster") == best["c"]).alias("same_meaning"),
    )


def nearest_open(
    closed: DataFrame, df: DataFrame, pool: DataFrame, key: str, vector: str, block_rows: int = CELL_ROWS
) -> DataFrame:
    """Add the winner once ``pool`` rows compete; the closed neighbour wins ties."""
    found = nearest(
        df.select(F.col(key).alias("key"), F.col(vector).alias("v")), pool.select(F.col(key).alias("key"), F.col(vector).alias("v")),
        "key", "v", 1, cell_rows=block_rows,
    ).filter("size(best) > 0")
    best = F.col("best")[0]
    out = found.select("key", (-best["minus"]).alias("pool_similarity"), best["key"].alias("pool_key"))
    stays = F.col("pool_similarity").isNull() | (F.col("similarity") >= F.col("pool_similarity"))
    return (
        closed.join(out, "key", "left")
        .withColumn(
            "open_pool_neighbour",
            F.when(stays, F.col("neighbour")).otherwise(F.col("pool_key")),
        )
        .withColumn("open_pool_same_meaning", stays & F.col("same_meaning"))
        .drop("pool_key", "pool_similarity")
    )


def neighbour_efficiency(neighbours: DataFrame, by_cluster: bool = False) -> DataFrame:
    """Share of rows whose neighbour means the same, in percent."""
    aggs = [F.count("*").alias("n_rows"),
            (F.avg(F.col("same_meaning").cast("int")) * 100).alias("efficiency_closed_pct")]
    if "open_pool_same_meaning" in neighbours.columns:
        aggs.append(
            (F.avg(F.col("open_pool_same_meaning").cast("int")) * 100).alias("efficiency_open_pct")
        )
    if by_cluster:
        return neighbours.groupBy(F.col("true_cluster").alias("cluster")).agg(*aggs)
    return neighbours.agg(*aggs)


def misses(neighbours: DataFrame, n: int = 10) -> DataFrame:
    """The first rows whose neighbour means something else."""
    return neighbours.filter("NOT same_meaning").orderBy("key").limit(n)


def top_similar(
    queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int = 5,
    block_rows: int = CELL_ROWS,
) -> DataFrame:
    """The ``k`` most similar corpus rows of every query: query, rank, neighbour, similarity."""
    side = lambda df: df.select(F.col(key).alias("key"), F.col(vector).alias("v"))
    found = nearest(side(queries), side(corpus), "key", "v", k, cell_rows=block_rows)
    ranked = found.select(F.col("key").alias("query"), F.posexplode("best").alias("place", "best"))
    return ranked.select(
        "query", (F.col("place") + 1).alias("rank"), F.col("best")["key"].alias("neighbour"),
        (-F.col("best")["minus"]).alias("similarity"),
    )


def top_similar_to(corpus: DataFrame, vector: str, query: list[float], k: int = 5) -> DataFrame:
    """The ``k`` rows most similar to one vector."""
    target = F.array(*[F.lit(float(x)) for x in query])
    sims = F.round(vx.cosine_raw(F.col(vector), target), DIGITS)
    return corpus.withColumn("similarity", sims).orderBy(
        F.desc("similarity"), corpus.columns[0]
    ).limit(k)


def vector_profile(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Length, sum and extremes of each vector."""
    v = F.col(vector)
    return df.select(
        key, vx.norm(v).alias("norm"), vx.total(v).alias("total"),
        F.array_min(v).cast("double").alias("low"), F.array_max(v).cast("double").alias("high"),
    )


def pair_check(
    pairs: DataFrame, raw: DataFrame, normalized: DataFrame, key: str, vector: str,
    threshold: float = THRESHOLD, tolerance: float = DRIFT_TOLERANCE,
) -> DataFrame:
    """Similarity of listed pairs (pair_id, left_id, right_id, documented) in two
    encodings, the lift, and the drift from the documented value."""

    def joined(frame: DataFrame, encoded: DataFrame, out: str) -> DataFrame:
        left = encoded.select(F.col(key).alias("left_id"), F.col(vector).alias("_l"))
        right = encoded.select(F.col(key).alias("right_id"), F.col(vector).alias("_r"))
        both = frame.join(left, "left_id").join(right, "right_id")
        return both.withColumn(out, vx.cosine_raw(F.col("_l"), F.col("_r"))).drop("_l", "_r")

    both = joined(joined(pairs, raw, "raw"), normalized, "normalized")
    drift = F.col("normalized") - F.col("documented")
    return both.select(
        "pair_id", "raw", "normalized",
        (F.col("normalized") - F.col("raw")).alias("lift"),
        drift.alias("drift"),
        (F.col("normalized") > threshold).alias("passes_threshold"),
        (F.abs(drift) <= tolerance).alias("matches_documented"),
    )


def pair_check_summary(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.avg("raw").alias("mean_raw"),
        F.avg("normalized").alias("mean_normalized"),
        F.avg("lift").alias("mean_lift"),
        F.count_if(~F.col("passes_threshold")).alias("pairs_below_threshold"),
        F.count_if(~F.col("matches_documented")).alias("pairs_drifted"),
    )


def vector_contract(
    vectors: DataFrame, key: str, vector: str, expected: DataFrame | None = None,
    dim: int | None = None,
) -> DataFrame:
    """One row of facts a vector table must satisfy, and the verdict."""
    v = F.col(vector)
    facts = vectors.agg(
        F.count("*").alias("n_rows"),
        F.min(F.size(v)).alias("min_dim"),
        F.max(F.size(v)).alias("max_dim"),
        F.count_if(v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x))).alias("n_not_finite"),
    )
    if expected is not None:
        missing = expected.join(vectors.select(key), key, "left_anti").agg(F.count("*")).scalar()
        facts = facts.withColumn("n_missing", missing)
    else:
        facts = facts.withColumn("n_missing", F.lit(0).cast("long"))
    right_dim = F.col("max_dim") == (F.lit(dim) if dim else F.col("min_dim"))
    return facts.withColumn(
        "is_valid",
        F.coalesce(
            (F.col("n_rows") > 0) & right_dim & (F.col("min_dim") == F.col("max_dim"))
            & (F.col("n_not_finite") == 0) & (F.col("n_missing") == 0),
            F.lit(False),
        ),
    )


def check_unique_members(long_clusters: DataFrame, text: str = "text") -> DataFrame:
    """The long cluster table unchanged; an error when a text is listed twice."""
    twice = long_clusters.groupBy(text).count().filter("count > 1").limit(5).collect()
    if twice:
        shown = ", ".join(repr(r[text]) for r in twice)
        raise ValueError(f"texts listed more than once: {shown}")
    return long_clusters


