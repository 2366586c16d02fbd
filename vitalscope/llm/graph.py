"""Connected components of a table of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vitalscope.operators.skew import lookup_join
from vitalscope.session import is_small

from .common import released, stored


HELD = 1 << 18  # links that a task holds at once


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as hold together what the links (a, b) hold together: each node and the least it reaches."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = both[:len(a)], both[len(a):]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[label[other]], nodes[other]


def _contracted(both: bool):
    """Links that hold together the same nodes: a task's links become stars around least nodes.

    A node that stands in no other link comes with itself. ``both``: every link in both directions.
    """
    def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        root, node = forest(a, b)
        alone = np.setdiff1d(a[a == b], node)
        return np.concatenate([root, alone]), np.concatenate([node, alone])

    def rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        if both:
            a, b = np.concatenate([a, b]), np.concatenate([b, a])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches):
        held = [np.zeros((2, 0), np.int64)]
        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy() for i in range(2)]))
            if sum(x.shape[1] for x in held) > HELD:
                held = [np.stack(stars(*np.concatenate(held, axis=1)))]
                if held[0].shape[1] > HELD // 2:
                    yield rows(*held.pop())
        if held:
            yield rows(*stars(*np.concatenate(held, axis=1)))
    return run


def components(links: DataFrame) -> DataFrame:
    """node, comp: the smallest node that each node of the links (a, b) reaches.

    Tasks first put stars in the place of their links, before and after these are dealt
    out anew, which leaves few rounds: one, where all links come into one task.
    Every round a node takes the least label of its neighbours and the label that
    its least label had before, so the rounds follow the logarithm of a component's width
    for chains as well as stars. Labels are written to the shared folder once a round;
    how they are joined depends on their number, which no round changes.

    Defined cases: links may repeat, run both ways or join a node to itself (which
    is then its own component); those with a null end are left out; no links, no rows.
    """
    links = links.filter("a is not null and b is not null")
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    edges = stored(links.mapInArrow(released(_contracted(False)), "a long, b long").distinct().mapInArrow(released(_contracted(True)), "a long, b long"))
    label = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp")).select("node", F.least("node", "comp").alias("comp")))
    few = is_small(label)

    def joined(rows: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
        return rows.join(F.broadcast(lookup), key) if few else lookup_join(rows, lookup, key, "inner")

    while True:
        near = joined(edges, label.select(F.col("node").alias("b"), "comp"), "b")
        least = near.groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        lower = label.join(least, "node").select("node", F.col("comp").alias("before"), F.least("comp", "near").alias("comp"))
        jump = joined(lower, label.select(F.col("node").alias("comp"), F.col("comp").alias("beyond")), "comp")
        label = stored(jump.select("node", "before", F.least("comp", "beyond").alias("comp")))
        if label.filter("comp != before").isEmpty():
            return label.select("node", "comp")
        label = label.select("node", "comp")
