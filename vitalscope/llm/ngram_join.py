"""N-gram Jaccard join with count-vector R-trees, and the components of its links.

Two documents link when their sets of word shingles overlap by ``share`` percent of
their union. Tokens (shingles) are hashed into groups, and a document becomes the
point of its group counts. The summed minima of two points bound the overlap of the
sets; only pairs that can still reach the share are verified on whole sets.

Which documents meet is exact: documents of like size share a scheme with more
groups than a linked pair can differ in elements, so that at least one group holds
the very same elements in both. A page of the tree is therefore a size band, a
group and the digest of the group's elements. Empty groups would be a page of
strangers; a scheme has a few groups to spare, and a document sends its empty ones
only if it has that many. Pages with the same members, each as often, are kept once.

Rounds: (1) every member of a page is compared with the page's smallest
document; (2) where a page still holds several components, an R-tree over the
points of its members finds the pairs across components that may link. A page is
cut into tiles, so no task holds a whole large page, and groups of copies never
become pairs of all with all: pairs inside a component are not looked at.

Texts of equal sets are one class first. Nothing is dropped or capped.

Defined cases: null and empty texts have no shingles and link with nothing; texts
below ``k`` words are one shingle of all their words; a null doc_id takes part in
no link and has a null component; rows that repeat a doc_id are judged each by its
own text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vitalscope.operators.skew import lookup_join
from vitalscope.session import small_side

from .common import Words, blocks, fresh, mix, released, stored, window_hashes, with_id
from .graph import components

RATIO = 1.5  # of the sizes of neighbouring bands
COUNTS = 128  # groups of the count vectors, a power of 2
TILE, LEAF, SMALL = 512, 16, 128
PAGE_ROWS = 1 << 16  # of the rows of pages that leave a task together
SLOT = 20_000  # rows of pages that one call compares
FEW_PAGES = 500_000  # page numbers that are broadcast, 8 bytes each
_A, _B, _C = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of a block, sorted by both."""
    w = Words(texts, lower=True)
    n = np.diff(w.first)
    doc = np.repeat(np.arange(len(texts)), n)
    hashed = w.hashes()
    grams = window_hashes(hashed, k)
    fits = np.arange(len(w)) + k <= w.first[1:][doc]
    docs, values = [doc[fits]], [grams[fits]]
    for short in range(1, k):  # the whole sequence of a short text
        own = np.flatnonzero(n == short)
        if len(own):
            docs.append(own)
            values.append(mix(window_hashes(hashed, short)[w.first[own]] + np.uint64(short)))
    doc, value = np.concatenate(docs), np.concatenate(values)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def bands(largest: int) -> np.ndarray:
    """Lower ends of the size bands, up to beyond ``largest``."""
    ends = [1]
    while ends[-1] <= largest:
        ends.append(max(ends[-1] + 1, int(ends[-1] * RATIO)))
    return np.array([*ends, max(ends[-1] + 1, int(ends[-1] * RATIO))])


def scheme(top: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
    """(most elements a linked pair of sizes up to ``top`` differs in, groups to spare)."""
    differ = (100 - share) * 2 * top // (100 + share)
    return differ, 1 + differ // 16


def pages(doc: np.ndarray, value: np.ndarray, count: int, share: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, page) of every page that a text of the block is on."""
    size = np.bincount(doc, minlength=count)
    ends = bands(int(size.max(initial=0) * 100 // share) + 1)
    own = np.searchsorted(ends, size, "right") - 1
    out_doc, out_page = [], []
    step = 0
    while True:
        band = own + step
        reach = (size > 0) & (ends[np.minimum(band, len(ends) - 1)] * share <= size * 100) if step else size > 0
        if not reach.any():
            break
        band = np.minimum(band, len(ends) - 2)
        differ, spare = scheme(ends[band + 1] - 1, share)
        groups = np.where(reach & (differ > 0), differ + 1 + spare, 0)  # without a difference only equal sets link
        offset = np.cumsum(groups) - groups
        chosen = groups[doc] > 0
        d, v = doc[chosen], value[chosen]
        place = offset[d] + (mix(v * _A + band[d].astype(np.uint64)) % groups[d].astype(np.uint64)).astype(np.int64)
        total = int(groups.sum())
        digest = np.zeros(total, np.uint64)
        np.add.at(digest, place, mix(v + _B))
        filled = np.bincount(place, minlength=total) > 0
        owner = np.repeat(np.arange(count), groups)
        empty = np.bincount(owner[~filled], minlength=count)
        send = filled | (empty >= groups - differ)[owner]
        group = np.arange(total) - offset[owner]
        page = mix(mix(digest + group.astype(np.uint64) * _C) + band[owner].astype(np.uint64) * _A)
        out_doc.append(owner[send])
        out_page.append(page[send])
        step += 1
    if not out_doc:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc, page = np.concatenate(out_doc), np.concatenate(out_page)
    order = np.argsort(doc, kind="stable")
    return doc[order], page[order]


def packed(points: np.ndarray) -> list[bytes]:
    """Each point in the narrowest whole numbers that hold its counts: they travel once per page."""
    top = points.max(axis=1, initial=0)
    out: list[bytes] = [b""] * len(points)
    for kind, low, high in ((np.uint8, -1, 255), (np.uint16, 255, 65535), (np.uint32, 65535, np.inf)):
        own = np.flatnonzero((top > low) & (top <= high))
        for i, row in zip(own.tolist(), points[own].astype(kind)):
            out[i] = row.tobytes()
    return out


def unpacked(column) -> np.ndarray:
    column = list(column)
    width = np.array([len(c) for c in column], np.int64) // COUNTS
    out = np.empty((len(column), COUNTS), np.uint32)
    for kind in (np.uint8, np.uint16, np.uint32):
        own = np.flatnonzero(width == np.dtype(kind).itemsize)
        if len(own):
            out[own] = np.frombuffer(b"".join([column[i] for i in own.tolist()]), kind).reshape(-1, COUNTS)
    return out


def _signed(k: int):
    def run(batches):
        for batch in batches:
            for at, texts in blocks(batch.column(1)):
                doc, value = shingle_sets(texts, k)
                count = len(texts)
                size = np.bincount(doc, minlength=count)
                digests = np.zeros((2, count), np.uint64)
                np.add.at(digests[0], doc, mix(value ^ _B))
                np.add.at(digests[1], doc, mix(value ^ _C))
                points = np.bincount(doc * COUNTS + (value >> np.uint64(65 - COUNTS.bit_length())).astype(np.int64), minlength=count * COUNTS)
                points = packed(points.reshape(count, COUNTS))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, count), pa.array(size.astype(np.int64)), *(pa.array(d.view(np.int64)) for d in digests),
                    pa.array(points, pa.binary()),
                ], ["doc_id", "n", "d1", "d2", "point"])
    return run


def _paged(k: int, share: int):
    def run(batches):
        for batch in batches:
            for at, texts in blocks(batch.column(1)):
                owner, page = pages(*shingle_sets(texts, k), len(texts), share)
                for low in range(0, len(page), PAGE_ROWS):
                    own = pa.array(owner[low:low + PAGE_ROWS])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(page[low:low + PAGE_ROWS].view(np.int64)), batch.column(0).slice(at, len(texts)).take(own),
                    ], ["page", "doc_id"])
    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            for at, texts in blocks(batch.column(1)):
                doc, value = shingle_sets(texts, k)
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(pa.array(ends), pa.array(value.view(np.int64)))], ["node", "set"]
                )
    return run


def needed(n: np.ndarray, m: np.ndarray, share: int) -> np.ndarray:
    """Least overlap at which sets of these sizes link."""
    return -(-share * (n + m) // (100 + share))


def _bounded(share: int):
    """Keep pairs whose summed coordinate minima reach the overlap they need."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (unpacked(batch.column(i).to_pylist()) for i in (4, 5))
                n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                keep = np.minimum(a, b).sum(1) >= needed(n, m, share)
                yield batch.select([0, 1]).filter(pa.array(keep))
    return run


class RTree:
    """Points in leaves of LEAF, leaves in nodes of LEAF, with the largest counts and least size of each."""

    def __init__(self, points: np.ndarray, size: np.ndarray) -> None:
        spread = np.argsort(-points.astype(float).var(0))[:3]
        self.order = np.lexsort((*points[:, spread].T, size // 8))
        self.points, self.size = points[self.order], size[self.order]
        self.levels = []
        top, least = self.points, self.size
        while len(top) > LEAF:
            cuts = np.arange(0, len(top), LEAF)
            top, least = np.maximum.reduceat(top, cuts, 0), np.minimum.reduceat(least, cuts)
            self.levels.append((top, least))

    def search(self, point: np.ndarray, n: int, share: int) -> np.ndarray:
        """Places (in the given order) of the points that may link with a set of size ``n``."""
        alive = np.arange(len(self.levels[-1][0]) if self.levels else len(self.points))
        for i in reversed(range(len(self.levels))):
            top, least = self.levels[i]
            fine = alive[np.minimum(top[alive], point).sum(1) >= needed(n, least[alive], share)]
            alive = (fine[:, None] * LEAF + np.arange(LEAF)).ravel()
            alive = alive[alive < (len(self.levels[i - 1][0]) if i else len(self.points))]
        fine = np.minimum(self.points[alive], point).sum(1) >= needed(n, self.size[alive], share)
        return self.order[alive[fine]]


def _across(share: int):
    """Pairs across components that may link, in all pages (and tiles of large ones) of a slot."""
    def runs(frame: pd.DataFrame):
        """The frame sorted by page and tile, and the ranges of each."""
        frame = frame.sort_values(["page", "i", "j"], kind="stable")
        tile = frame[["page", "i", "j"]].to_numpy()
        cuts = np.flatnonzero(np.append(True, (tile[1:] != tile[:-1]).any(1))) if len(tile) else np.zeros(0, int)
        return frame, {tuple(tile[a]): (a, b) for a, b in zip(cuts, np.append(cuts[1:], len(tile)))}

    def run(key, every: pd.DataFrame, minor: pd.DataFrame) -> pd.DataFrame:
        found = [np.zeros((0, 2), np.int64)]
        if len(every) and len(minor):
            (every, left), (minor, right) = runs(every), runs(minor)
            p, q = unpacked(every["point"]), unpacked(minor["point"])
            facts = [(f["n"].to_numpy(), f["node"].to_numpy(), f["comp"].to_numpy()) for f in (every, minor)]
            for tile, (c, d) in right.items():
                a, b = left.get(tile, (0, 0))
                (n, node, comp), (m, own, part) = ([x[u:v] for x in f] for f, u, v in zip(facts, (a, c), (b, d)))
                if b - a <= SMALL:
                    fine = np.minimum(p[None, a:b], q[c:d, None]).sum(2) >= needed(m[:, None], n[None], share)
                    j, i = np.nonzero(fine & (part[:, None] != comp[None]))
                else:
                    tree = RTree(p[a:b], n)
                    near = [tree.search(q[c + k], int(m[k]), share) for k in range(d - c)]
                    near = [x[comp[x] != part[k]] for k, x in enumerate(near)]
                    i, j = np.concatenate(near), np.repeat(np.arange(d - c), [len(x) for x in near])
                found.append(np.stack([np.minimum(node[i], own[j]), np.maximum(node[i], own[j])], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})
    return run


def _common(share: int):
    def run(key, pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        own: dict[int, list] = {}
        for node, one in zip(sets["node"], sets["set"]):
            own.setdefault(node, []).append(one)  # several where rows repeat a doc_id
        keep = []
        for a, b in zip(pairs["a"], pairs["b"]):
            linked = False
            for x in own[a]:
                for y in own[b]:
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    linked |= 100 * common >= share * (len(x) + len(y) - common)
            keep.append(linked)
        return pairs.loc[np.array(keep, bool), ["a", "b"]]
    return run


def _verified(docs: DataFrame, pairs: DataFrame, k: int, share: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets.

    Pairs that hang together form a family, cut into blocks of TILE / 2 documents; a
    set travels once to each pair of blocks that needs it, not once per pair.
    """
    family = components(pairs)
    sizes = family.groupBy("comp").agg(F.ceil(F.count("*") / (TILE // 2)).cast("int").alias("blocks"))
    placed = lookup_join(family, sizes, "comp").select("node", "comp", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    placed = stored(placed)
    of = lambda c: placed.select(F.col("node").alias(c), F.col("comp").alias(f"f{c}"), F.col("block").alias(f"o{c}"))
    tiled = lookup_join(lookup_join(pairs, of("a"), "a", "inner"), of("b").drop("fb"), "b", "inner")
    tiled = stored(tiled.select(F.col("fa").alias("f"), F.least("oa", "ob").alias("i"), F.greatest("oa", "ob").alias("j"), "a", "b"))
    wanted = tiled.select("f", "i", "j", F.explode(F.array("a", "b")).alias("node")).distinct()
    nodes = placed.select(F.col("node").alias("doc_id"))
    texts = docs.join(small_side(nodes, FEW_PAGES), "doc_id", "left_semi")
    sets = texts.mapInArrow(released(_sets(k)), "node long, set array<long>")
    sent = wanted.join(sets, "node")
    keys = ("f", "i", "j")
    checked = tiled.groupBy(*keys).cogroup(sent.select(*[F.col(c).alias(c) for c in (*keys, "node", "set")]).groupBy(*keys))
    return checked.applyInPandas(_common(share), "a long, b long")


def link_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, share: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of every row."""
    rows = with_id(docs, key, text)
    signed = stored(rows.mapInArrow(released(_signed(k)), "doc_id long, n long, d1 long, d2 long, point binary"))
    taking_part = signed.filter("doc_id is not null and n > 0")
    classes = stored(taking_part.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("node"), F.first("point").alias("point")))
    # One row per document: which class it is in. Hot classes are served apart.
    tag = F.xxhash64("n", "d1", "d2")
    slim = taking_part.select("doc_id", "n", "d1", "d2", tag.alias("tag"))
    multiple = taking_part.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("last")).filter("last > node")
    multiple = stored(multiple.select(tag.alias("tag"), F.col("n").alias("cn"), F.col("d1").alias("c1"), F.col("d2").alias("c2"), "node"))
    same = "n = cn and d1 = c1 and d2 = c2"
    copies = stored(lookup_join(slim, multiple, "tag", "inner").filter(same).filter("doc_id > node").select("doc_id", "n", "d1", "d2", "node"))

    # Pages are made from the texts once more and shuffled as page and document alone: most have one
    # member and end there, so neither a table of all pages nor partial sums of them are written.
    on_page = rows.filter("doc_id is not null").mapInArrow(released(_paged(k, share)), "page long, doc_id long")
    of_page = Window.partitionBy("page")
    spans = on_page.withColumn("low", F.min("doc_id").over(of_page)).withColumn("high", F.max("doc_id").over(of_page))
    shared = stored(spans.filter("high > low").select("page", "doc_id"))
    # Which rows are on a page: sums of both halves of their hashes. Repeated rows add up, where an xor would cancel them.
    half = lambda h: F.sum(F.expr(h))
    full = shared.withColumn("h", F.xxhash64("doc_id")).groupBy("page").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), half("h & 4294967295L").alias("who"), half("shiftrightunsigned(h, 32)").alias("else")
    )
    kept = stored(full.groupBy("low", "high", "who", "else").agg(F.min("page").alias("page")).select("page"))
    members = stored(shared.join(small_side(kept, FEW_PAGES), "page"))
    nodes = members.join(copies.select("doc_id", "node").distinct(), "doc_id", "left")
    members = stored(nodes.select("page", F.coalesce("node", "doc_id").alias("node")).distinct())

    facts = classes.select("node", "n", "point")
    leads = members.groupBy("page").agg(F.min("node").alias("a"), F.max("node").alias("last")).filter("last > a").select("page", "a")
    stars = stored(lookup_join(members, leads, "page", "inner").filter("node > a").select("a", F.col("node").alias("b")).distinct())
    right = facts.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("point").alias("pb"))
    left = facts.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("point").alias("pa"))
    pointed = lookup_join(lookup_join(stars, right, "b", "inner"), left, "a", "inner").select("a", "b", "na", "nb", "pa", "pb")
    possible = stored(pointed.mapInArrow(released(_bounded(share)), "a long, b long").distinct())
    links = stored(_verified(rows, possible, k, share))
    label = components(links)

    # Pages that still hold several components: compare across them.
    placed = stored(members.join(label, "node", "left").select("page", "node", F.coalesce("comp", "node").alias("comp")))
    parts = placed.groupBy("page", "comp").agg(F.count("*").alias("c"))
    split = parts.groupBy("page").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("c").alias("m"), F.max("c").alias("most"))
    split = stored(split.filter("m > most").select(
        "page", "main", "m", "most", F.ceil(F.col("m") / TILE).cast("int").alias("jb"), F.ceil((F.col("m") - F.col("most")) / TILE).cast("int").alias("ib")
    ))
    mixed = lookup_join(placed, split, "page", "inner").join(facts, "node")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ("slot", "page", "i", "j", "node", "comp", "n", "point")
    slots = 1 + (split.agg(F.sum(F.col("m") * F.col("ib") + F.col("m") - F.col("most"))).first()[0] or 0) // SLOT
    slot = F.pmod(F.xxhash64("page", "i", "j"), F.lit(slots))
    all_ = mixed.withColumn("j", own("jb")).withColumn("i", every("ib")).withColumn("slot", slot).select(*columns)
    minor = mixed.filter("comp != main").withColumn("i", own("ib")).withColumn("j", every("jb")).withColumn("slot", slot)
    minor = minor.select(*[F.col(c).alias(c) for c in columns])
    across = all_.groupBy("slot").cogroup(minor.groupBy("slot")).applyInPandas(_across(share), "a long, b long")
    more = stored(across.distinct().join(possible, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        label = components(links.unionByName(_verified(rows, more, k, share)))

    member_of = copies.select("doc_id", "n", "d1", "d2", "node").distinct()
    keys = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("doc_id", "n", "d1", "d2")]
    named = signed.select("doc_id", "n", "d1", "d2").join(
        member_of.select(*[F.col(c).alias(f"__{c}") for c in ("doc_id", "n", "d1", "d2")], "node"), keys[0] & keys[1] & keys[2] & keys[3], "left"
    ).select("doc_id", "n", F.coalesce("node", "doc_id").alias("node"))
    return lookup_join(named, label, "node").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("comp", "node")).otherwise(F.col("doc_id")).alias("component_id")
    )


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, share: int = 80) -> DataFrame:
    """``docs`` with the document of the smallest doc_id of each component; all columns stay.

    Documents without words or doc_id stay, and of rows that repeat a doc_id one does.
    """
    found = stored(link_components(docs, key, text, k, share).filter("doc_id is not null"))
    (name,) = fresh(docs, "__id")
    heads = found.filter("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    own = F.col(f"`{key}`").cast("long")
    kept = docs.filter(own.isNotNull()).join(heads, own == F.col(name), "left_semi")
    if not found.groupBy("doc_id").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates([key])
    return kept.unionByName(docs.filter(own.isNull()))
