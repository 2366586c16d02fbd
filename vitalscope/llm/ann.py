"""Nearest neighbours through learned partitions.

A bounded sample of the vectors gives a neighbour graph; a balanced partitioning
of that graph puts neighbours together, and a small network learns which parts a
vector's neighbours lie in. Every row is indexed under its most probable part,
and a query is compared with the rows of its most probable parts, by the exact
distance in double precision. How many parts is measured: vectors held out of
the sample are the queries, and the fewest parts that hold ``TARGET`` of their
neighbours are searched. Clustered vectors need a few; directions spread evenly
over the sphere need many, whatever the method.

Only the fit looks at a sample (``SAMPLE`` rows by a hash of their ids, under 20 MB
on the driver); the index holds every row. Parts are cut into blocks of at most
about ``ROWS`` rows and ``QUERIES`` queries, so no part, however many equal
vectors it holds, meets in one task; a block sends its ``k`` best for each query.

Defined cases: vectors that are null, zero, of another length than most, or hold
null or non-finite components take no part, nor do rows without an id; ties go
to the smaller vec_id; rows that repeat a vec_id are separate candidates, and a
repeated query id is one query (its smallest vector); fewer candidates than
``k`` give them all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

SAMPLE = 16_000
NEIGHBOURS = 12
ROWS, QUERIES = 4096, 1024
SEED = 7
TARGET = 0.95  # share of the neighbours in the parts searched, measured on held-out rows


def usable(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Columns vec_id, v (array<double>) of the rows that take part."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & fine)
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("v") == (width[0]["n"] if width else 0))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the ``k`` nearest other rows of each row of a bounded sample."""
    k = min(k, len(x) - 1)
    square, out = (x * x).sum(1), np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 512):
        d = square[None, :] - 2 * x[at:at + 512] @ x.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out[at:at + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 6) -> np.ndarray:
    """A part per vertex: neighbours together, no part above 1.15 times the mean size.

    Starts from a capacity-bound grouping around spread centres, then moves each
    vertex to the part of most of its neighbours while that has room.
    """
    n = len(x)
    room = int(np.ceil(1.15 * n / parts))
    rng = np.random.default_rng(SEED)
    centres = x[rng.choice(n, parts, replace=False)]
    for _ in range(8):
        own = np.argmin((centres * centres).sum(1)[None] - 2 * x @ centres.T, axis=1)
        for p in np.unique(own):
            centres[p] = x[own == p].mean(0)
    d = (centres * centres).sum(1)[None] - 2 * x @ centres.T
    order = np.argsort(np.partition(d, 1, axis=1)[:, 0] - np.partition(d, 1, axis=1)[:, 1]) if parts > 1 else np.arange(n)
    prefers, label, size = np.argsort(d, axis=1), np.full(n, -1), np.zeros(parts, int)
    for i in order:
        for p in prefers[i]:
            if size[p] < room:
                label[i], size[p] = p, size[p] + 1
                break
    back = [[] for _ in range(n)]
    for i, row in enumerate(near):
        for j in row:
            back[j].append(i)
    links = [np.concatenate([near[i], np.array(back[i], np.int64)]) for i in range(n)]
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(label[links[i]], minlength=parts).astype(float)
            votes[size >= room] = -1
            votes[label[i]] = max(votes[label[i]], (label[links[i]] == label[i]).sum())
            best = int(votes.argmax())
            if best != label[i] and votes[best] > votes[label[i]]:
                size[label[i]] -= 1
                size[best] += 1
                label[i] = best
                moved += 1
        if moved < n // 200:
            break
    return label


class Router:
    """A network with one hidden layer: vector -> probability of each part."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 30) -> None:
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = x.mean(0), x.std() + 1e-12
        z = (x - self.mean) / self.scale
        shapes = ((x.shape[1], hidden), (hidden,), (hidden, target.shape[1]), (target.shape[1],))
        self.w = [rng.normal(0, (2 / s[0]) ** 0.5, s) if len(s) == 2 else np.zeros(s) for s in shapes]
        m, v, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for epoch in range(epochs):
            for rows in np.array_split(rng.permutation(len(z)), max(1, len(z) // 256)):
                h = np.maximum(z[rows] @ self.w[0] + self.w[1], 0)
                p = self._softmax(h @ self.w[2] + self.w[3])
                e = (p - target[rows]) / len(rows)
                g = e @ self.w[2].T * (h > 0)
                step += 1
                rate = 3e-3 * (1 - epoch / epochs) + 1e-4
                for k, grad in enumerate((z[rows].T @ g, g.sum(0), h.T @ e, e.sum(0))):
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    self.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    @staticmethod
    def _softmax(s: np.ndarray) -> np.ndarray:
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def scores(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.mean) / self.scale @ self.w[0] + self.w[1], 0)
        return self._softmax(h @ self.w[2] + self.w[3])


def fit(vectors: DataFrame, parts: int | None = None, sample: int = SAMPLE) -> tuple[Router | None, int]:
    """(router, parts to search) from at most ``sample`` rows; no router where there are too few to divide."""
    rows = vectors.select(F.xxhash64("vec_id").alias("h"), "v").orderBy("h").limit(sample).collect()
    x = np.unique(np.array([r["v"] for r in rows]), axis=0) if rows else np.zeros((0, 1))
    held, x = np.split(np.random.default_rng(SEED).permutation(x), [min(1000, len(x) // 10)])
    parts = parts or int(np.clip(len(x) // 250, 1, 64))
    if parts < 2 or len(x) < 4 * parts:
        return None, 1
    near = neighbour_graph(x, NEIGHBOURS)
    label = balanced_parts(x, near, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x)), label), 1.0)
    for column in near.T:
        np.add.at(target, (np.arange(len(x)), label[column]), 1.0)
    router = Router(x, target / target.sum(1, keepdims=True))
    return router, probes_needed(router, held, x)


def probes_needed(router: Router, held: np.ndarray, x: np.ndarray, k: int = 10) -> int:
    """The fewest parts that hold TARGET of the ``k`` nearest rows of the held-out vectors."""
    own = router.scores(x).argmax(1)
    order = np.argsort(-router.scores(held), axis=1, kind="stable")
    d = (x * x).sum(1)[None] - 2 * held @ x.T
    near = np.argpartition(d, min(k, len(x) - 1), axis=1)[:, :k]
    place = np.argsort(order, axis=1)  # rank of each part for each held-out vector
    reached = np.bincount(np.take_along_axis(place, own[near], axis=1).ravel(), minlength=order.shape[1]).cumsum()
    return int(np.searchsorted(reached, TARGET * near.size)) + 1


def _routed(router: Router | None, probes: int):
    def run(frames):
        for frame in frames:
            if router is None or not len(frame):
                yield frame.assign(part=0)
                continue
            p = router.scores(np.stack(frame["v"].to_numpy()))
            best = np.argsort(-p, axis=1, kind="stable")[:, :probes]
            out = frame.loc[frame.index.repeat(best.shape[1])].copy()
            out["part"] = best.ravel()
            yield out
    return run


def _nearest(k: int):
    def run(key, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            rows = rows.sort_values("vec_id", kind="stable")
            x, ids = np.stack(rows["v"].to_numpy()), rows["vec_id"].to_numpy()
            square = (x * x).sum(1)
            for at in range(0, len(queries), 256):
                part = queries.iloc[at:at + 256]
                q, own = np.stack(part["v"].to_numpy()), part["vec_id"].to_numpy()
                rough = square[None] - 2 * q @ x.T + (q * q).sum(1)[:, None]
                rough[own[:, None] == ids[None]] = np.inf
                keep = min(k, len(ids))
                border = np.partition(rough, keep - 1, axis=1)[:, keep - 1]
                slack = 1e-9 * (square.max() + (q * q).sum(1))  # rounding of the rough distances
                for i in range(len(q)):
                    near = np.flatnonzero(rough[i] <= border[i] + slack[i])
                    near = near[np.isfinite(rough[i][near])]
                    d = np.sqrt(((x[near] - q[i]) ** 2).sum(1))
                    first = np.lexsort((ids[near], d))[:k]
                    out.append(pd.DataFrame({"query_id": own[i], "vec_id": ids[near][first], "score": d[first]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    return run


def search(
    df: DataFrame, queries: Column, k: int = 10, probes: int | None = None, key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for the rows where ``queries`` holds.

    ``queries`` is a condition on the column vec_id.
    """
    vectors = usable(df, key, vector)
    router, needed = fit(vectors)
    probes = probes or needed
    schema = "vec_id long, v array<double>, part int"
    indexed = vectors.mapInPandas(_routed(router, 1), schema)
    asked = vectors.filter(queries).groupBy("vec_id").agg(F.min("v").alias("v")).mapInPandas(_routed(router, probes), schema)
    asked = stored(asked)
    rows = indexed.groupBy("part").agg(F.count("*").alias("n"))
    wanted = asked.groupBy("part").agg(F.count("*").alias("m"))
    # One row per part: how many blocks its rows and its queries are cut into.
    cuts = F.broadcast(stored(rows.join(wanted, "part").select(
        "part", F.ceil(F.col("n") / ROWS).cast("int").alias("rb"), F.ceil(F.col("m") / QUERIES).cast("int").alias("qb")
    )))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    left = indexed.join(cuts, "part").withColumn("r", own("rb")).withColumn("q", every("qb"))
    right = asked.join(cuts, "part").withColumn("q", own("qb")).withColumn("r", every("rb"))
    found = left.select("part", "r", "q", "vec_id", "v").groupBy("part", "r", "q").cogroup(
        right.select("part", "r", "q", "vec_id", "v").groupBy("part", "r", "q")
    ).applyInPandas(_nearest(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
