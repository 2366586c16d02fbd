"""SimHash near-duplicates with pivot distance tables.

A document's fingerprint has a bit where over half of the XXH64 values of its word
shingles (repeats included) have it. Fingerprints link at ``within`` or fewer differing bits, and a
document's class is the smallest doc_id that it reaches by links.

Pivots are reference fingerprints drawn from the data, about the square root of
PER_PIVOT times the number of distinct fingerprints, so that dense regions have more of them. The table of
Hamming distances to all pivots is worked out in blocks, and serves three times. Its
least entry is a fingerprint's home cell. By the triangle inequality, of two that link the
one farther from its pivot has the other's pivot within its own least distance plus
``within``: it visits these cells, so every link is met in a cell, and no
others are. And what lies ``within`` of a pivot is linked to it without looking at pairs.
Inside a cell, pairs whose distances to any of TABLE pivots differ by more than ``within``
are discarded by the largest coordinate difference, and the survivors are verified bit by bit.

Hot spots: equal fingerprints are one row first. Links to pivots are joined into components before pairs are
looked at; a cell whose home rows are all of one component is not visited by that component, so a
dense heap of near copies is neither sent around nor compared. Large cells are cut into tiles of
bounded size, and a tile gives one link per pair of components. Nothing is capped: beyond MOST pivots
cells only grow, and are cut into more tiles.

Defined cases: a text with fewer words than a shingle is one shingle of all its words; a null, empty or
blank text has the fingerprint zero and links like any other; rows that repeat a doc_id are judged each by its own
text; a null doc_id takes part in no link and has a null component; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vitalscope.operators.skew import lookup_join

from .common import blocks, stored, with_id
from .graph import components, forest

SEED = 42
PER_PIVOT = 20
MOST = 1 << 18  # pivots, 8 bytes each; sent to every task
TABLE = 16  # coordinates of the table inside a cell
HOMES, ALL = 1024, 8192  # rows of a tile: of the cell itself, and with its visitors
ENTRIES = 1 << 21  # of a table worked out at once
SHINGLES = 1 << 16  # whose bits are counted at once


def fingerprint(text: str, k: int, digest) -> int:
    """The fingerprint of a text; ``digest`` maps bytes and a seed to 64 bits."""
    words = text.encode().lower().split()  # white space and A-Z of ASCII only
    if not words:
        return 0
    k = min(k, len(words))
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-k]]
    hashed = np.array([digest(joined[a:b - 1], SEED) for a, b in zip(starts, ends[k - 1:])], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashed), SHINGLES):
        bits = np.unpackbits(hashed[at:at + SHINGLES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashed), bitorder="little").view("<u8")[0])


def _fingerprints(k: int):
    def run(batches):
        from xxhash import xxh64_intdigest

        for batch in batches:
            for at, texts in blocks(batch.column(1)):
                found = np.array([fingerprint(t, k, xxh64_intdigest) for t in texts.to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(found.view(np.int64))], ["doc_id", "fp"])
    return run


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3) -> DataFrame:
    """doc_id, fp (64 bits as a long) of every row."""
    return with_id(docs, key, text).mapInArrow(_fingerprints(k), "doc_id long, fp long")


def distances(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ pivots[None])


def _tabled(pivots: np.ndarray, lead: np.ndarray, within: int):
    """Home cell and least distance of each fingerprint (link false), and links with pivots."""
    step = max(1, ENTRIES // len(pivots))

    def run(batches):
        names = ["link", "a", "b", "cell", "least"]
        pivot_links = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            fps, node = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for at in range(0, len(fps), step):
                table = distances(fps[at:at + step], pivots)
                home, own = table.argmin(1), node[at:at + step]
                least = table[np.arange(len(home)), home]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.zeros(len(home), bool)), pa.array(own), pa.array(fps[at:at + step].view(np.int64)),
                    pa.array(home.astype(np.int32)), pa.array(least.astype(np.int32)),
                ], names)
                x, p = np.nonzero(table <= within)
                more = p != home[x]
                found = np.concatenate([pivot_links[0], home[x[more]]]), np.concatenate([pivot_links[1], p[more]])
                pivot_links = forest(*found)
                linked = (least <= within) & (own != lead[home])
                if linked.any():
                    yield _link_rows(own[linked], lead[home[linked]], names)
        if len(pivot_links[0]):
            yield _link_rows(lead[pivot_links[0]], lead[pivot_links[1]], names)
    return run


def _link_rows(a: np.ndarray, b: np.ndarray, names: list[str]) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(np.ones(len(a), bool)), pa.array(a), pa.array(b), none, none], names)


def _visiting(pivots: np.ndarray, only: np.ndarray, within: int):
    """The rows of every cell: those at home and their visitors. ``only`` has a cell's component where it holds just one."""
    step = max(1, ENTRIES // len(pivots))

    def run(batches):
        for batch in batches:
            fps, node, home, least, comp = (batch.column(i).to_numpy() for i in range(5))
            fps = fps.view(np.uint64)
            for at in range(0, len(fps), step):
                part = slice(at, at + step)
                visits = distances(fps[part], pivots) <= (least[part] + within)[:, None]
                visits &= only[None] != comp[part][:, None]
                own = np.arange(visits.shape[0])
                visits[own, home[part]] = True
                x, cell = np.nonzero(visits)
                yield pa.RecordBatch.from_arrays([
                    pa.array(cell.astype(np.int32)), pa.array(home[part][x] == cell), pa.array(fps[part][x].view(np.int64)), pa.array(comp[part][x]),
                ], ["cell", "home", "fp", "comp"])
    return run


def _linked(pivots: np.ndarray, within: int):
    """Links between the components of a tile: pairs that the table lets through, verified."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        side, fps, comp = frame["side"].to_numpy(), frame["fp"].to_numpy(np.int64).view(np.uint64), frame["comp"].to_numpy(np.int64)
        left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
        table = distances(fps, pivots)
        found = [np.zeros((0, 2), np.int64)]
        step = max(1, ENTRIES // max(1, len(right)))
        for at in range(0, len(left), step):
            rows = left[at:at + step]
            alive = comp[rows][:, None] != comp[right][None]
            for c in range(table.shape[1]):  # in uint8, differences below zero wrap round to large ones
                alive &= (table[rows, c] + np.uint8(within))[:, None] - table[right, c][None] <= 2 * within
            x, y = np.nonzero(alive)
            x, y = rows[x], right[y]
            near = np.bitwise_count(fps[x] ^ fps[y]) <= within
            found.append(np.unique(np.sort(np.stack([comp[x[near]], comp[y[near]]], 1), 1), axis=0))
        pairs = np.concatenate(found)
        a, b = forest(pairs[:, 0], pairs[:, 1])
        return pd.DataFrame({"a": a, "b": b})
    return run


def classes(prints: DataFrame, within: int = 3) -> DataFrame:
    """fp, component_id of every fingerprint that several rows have or that links with another.

    ``prints`` has doc_id and fp; its rows without doc_id are left out.
    """
    distinct = stored(prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("last")))
    count = distinct.count()
    if not count:
        return distinct.select("fp", F.col("node").alias("component_id"))
    wanted = min(MOST, math.isqrt(PER_PIVOT * count) + 1)
    drawn = F.pmod(F.xxhash64("fp"), F.lit(count)) < wanted  # as many as wanted on average
    chosen = distinct.filter(drawn).select("fp", "node").collect() or [distinct.select("fp", "node").first()]
    chosen.sort()
    pivots, lead = np.array([r["fp"] for r in chosen], np.int64).view(np.uint64), np.array([r["node"] for r in chosen], np.int64)

    tabled = distinct.select("fp", "node").mapInArrow(_tabled(pivots, lead, within), "link boolean, a long, b long, cell int, least int")
    tabled = stored(tabled)
    near_pivots = components(tabled.filter("link").select("a", "b"))
    placed = tabled.filter("not link").select(F.col("a").alias("node"), F.col("b").alias("fp"), "cell", "least")
    placed = stored(lookup_join(placed, near_pivots, "node").select("fp", "node", "cell", "least", F.coalesce("comp", "node").alias("comp")))

    # One row per cell, as many as there are pivots.
    only = np.full(len(pivots), np.iinfo(np.int64).min)
    for r in placed.groupBy("cell").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low = high").collect():
        only[r["cell"]] = r["low"]
    rows = stored(placed.mapInArrow(_visiting(pivots, only, within), "cell int, home boolean, fp long, comp long"))
    cells = rows.groupBy("cell").agg(
        F.ceil(F.count_if("home") / HOMES).cast("int").alias("ib"), F.ceil(F.count("*") / ALL).cast("int").alias("jb"),
        F.min("comp").alias("low"), F.max("comp").alias("high"),
    ).filter("low < high").select("cell", "ib", "jb")
    mixed = lookup_join(rows, stored(cells), "cell", "inner")
    spot = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    tiles = F.expr("""explode(concat(
        transform(sequence(0, ib - 1), x -> struct(x as i, own_j as j, if(home and x = own_i, 3, 2) as side)),
        if(home, transform(filter(sequence(0, jb - 1), y -> y != own_j), y -> struct(own_i as i, y as j, 1 as side)), array())))""")
    tiled = mixed.withColumn("own_i", spot("ib")).withColumn("own_j", spot("jb")).select("cell", "fp", "comp", tiles.alias("t"))
    tiled = tiled.select("cell", "t.i", "t.j", "t.side", "fp", "comp")
    table = pivots[np.linspace(0, len(pivots) - 1, min(TABLE, len(pivots))).astype(int)]
    met = stored(tiled.groupBy("cell", "i", "j").applyInPandas(_linked(table, within), "a long, b long"))

    joined = components(met).select(F.col("node").alias("comp"), F.col("comp").alias("whole"))
    named = lookup_join(placed, joined, "comp").select("fp", F.coalesce("whole", "comp").alias("component_id"), F.col("node").alias("least_id"))
    copies = distinct.filter("last > node").select(F.col("fp").alias("copy"))
    # The copies' smallest doc_id is their class unless a link takes them further.
    return stored(named.join(copies, F.col("fp") == F.col("copy"), "left").filter("copy is not null or component_id < least_id").select("fp", "component_id"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, within: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    prints = stored(fingerprints(docs, key, text, k))
    found = lookup_join(prints, classes(prints, within), "fp")
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )
