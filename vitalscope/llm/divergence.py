"""Source divergence audit with count-level bitmaps.

How far do the sources of a language differ in the terms they use? Each source has a
smoothed share p of every kept term (in parts of 10^9); a pair's divergence is the sum over
all kept terms of floor((p - q)^2 / q), and the terms of a source are ranked by the
same measure against its whole language.

Shares depend on a term's count alone, so a pair's sum is a sum over joint cells (count
here, count there) of the number of terms in the cell times f. For every (source,
count) a bitmap holds the ids of the terms with that count; the AND of two bitmaps has one bit
for each term of their joint cell, its popcount is the cell. Cells with a zero on one
side or both follow by complement: a level's size less what the other side's bitmaps
take from it. All arithmetic is on integers.

On Spark: terms are counted in the tasks first, then by (language, source, term). Ids are
given in chunks of terms, frequent ones in chunks of 64 and rare ones, which share a few
counts, in chunks of up to 4,096; a chunk's bitmaps are one small task, whichever source or language is
hot. Sources beyond SOURCES a language are compared in tiles. A chunk gives one partial sum
per pair of sources. The ranking of terms drops all but the first ``top`` of a group before its shuffle.

Defined cases: null text, language and source are ''; a group without terms, or without kept
ones, has counts of zero; a language without kept terms has value 0 for all its
pairs; a row is a document, so repeated rows count each; ties go by the item's UTF-8 bytes; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from vitalscope.operators.skew import lookup_join

from .common import stored

SCALE = 1_000_000_000
SOURCES = 128  # of one language in a tile
HELD = 200_000  # counts a task holds before it passes them on
CELLS = 1 << 21  # pairs of bitmap words looked at at once

# Bytes that belong to a term stay, A-Z in lower case; all others part terms.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _counted(batches):
    """lang, source, term, n, df of a task's documents; a term '' names every group."""
    held, size = {}, 0

    def passed_on():
        for (lang, source), (n, df) in held.items():
            terms = list(n)
            count = len(terms) + 1
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * count), pa.array([source] * count), pa.array(["", *(t.decode() for t in terms)]),
                pa.array([0, *n.values()], pa.int64()), pa.array([0, *(df[t] for t in terms)], pa.int64()),
            ], ["lang", "source", "term", "n", "df"])

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            n, df = held.setdefault((lang, source), (Counter(), Counter()))
            words = text.encode().translate(_LETTERS).split()
            size -= len(n)
            n.update(words)
            df.update(set(words))
            size += len(n)
            if size >= HELD:
                yield from passed_on()
                held, size = {}, 0
    yield from passed_on()


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences), df (documents); each group has a row with the term ''."""
    read = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    counted = read.mapInArrow(_counted, "lang string, source string, term string, n long, df long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _group(*columns: str) -> Column:
    """One text for several, which no other values share."""
    return F.concat_ws(":", *[F.length(c).cast("string") for c in columns], *columns)


def kept_cells(counts: DataFrame, least: int = 3) -> DataFrame:
    """lang, source, term, n, total, chunk of the terms in at least ``least`` documents of their language."""
    words = counts.filter("term != ''").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("df").alias("df"))
    words = stored(words.filter(F.col("df") >= least).select("lang", "term", "total", F.floor(F.log2("total")).cast("int").alias("band")))
    size = F.greatest(F.lit(64), F.floor(F.lit(4096) / F.pow(F.lit(2), "band"))).cast("long")
    bands = words.groupBy("lang", "band").agg(F.count("*").alias("terms"))
    bands = bands.select(_group("lang").alias("g"), "band", F.ceil(F.col("terms") / size).alias("chunks"))
    # One row per language: how many chunks each of its bands has.
    bands = bands.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("band", "chunks"))).alias("chunks"))
    placed = lookup_join(words.withColumn("g", _group("lang")), bands, "g").select(
        F.col("lang").alias("l"), F.col("term").alias("t"), "total",
        F.concat_ws(".", "band", F.pmod(F.xxhash64("term"), F.element_at("chunks", F.col("band")))).alias("chunk"),
    )
    joined = counts.filter("term != ''").join(placed, (F.col("lang") == F.col("l")) & (F.col("term") == F.col("t")))
    return joined.select("lang", "source", "term", "n", "total", "chunk")


def _levels(frame: pd.DataFrame) -> pd.DataFrame:
    """The bitmaps of a chunk: one per source and count."""
    terms, bit = np.unique(frame["term"].to_numpy(object), return_inverse=True)
    keys = frame[["source", "n"]].drop_duplicates().reset_index(drop=True)
    row = frame[["source", "n"]].merge(keys.reset_index(), how="left", on=["source", "n"])["index"].to_numpy()
    bits = np.zeros((len(keys), -(-len(terms) // 64) * 64), bool)
    bits[row, bit] = True
    packed = np.packbits(bits, axis=1)
    return keys.assign(lang=frame["lang"].iloc[0], chunk=frame["chunk"].iloc[0], bits=[p.tobytes() for p in packed])[["lang", "chunk", "source", "n", "bits"]]


def level_bitmaps(cells: DataFrame) -> DataFrame:
    """lang, chunk, source, n, bits: which terms of the chunk the source has n times."""
    return cells.groupBy("lang", "chunk").applyInPandas(_levels, "lang string, chunk string, source string, n long, bits binary")


def share(n: Column, size: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / size), exact for all longs."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", wide(n + 1) * F.lit(SCALE).cast("decimal(10,0)"), wide(size)) + 1


def _shares(n: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``share`` of arrays: long division by thousands, as SCALE * n may not fit."""
    out, rest = np.zeros_like(n), n + 1
    for _ in range(3):
        part, rest = np.divmod(rest * 1000, size)
        out = out * 1000 + part
    return out + 1


def distance(p, q):
    return (p - q) * (p - q) // q


def _joint(frame: pd.DataFrame) -> pd.DataFrame:
    """Sums over the joint cells without zeros of all pairs of sources in a tile of a chunk.

    What the complements count for these cells (f with one side or both at zero) is taken off.
    """
    bits = np.frombuffer(b"".join(frame["bits"]), np.uint64).reshape(len(frame), -1)
    names, source = np.unique(frame["source"].to_numpy(object), return_inverse=True)
    n, size, block = (frame[c].to_numpy(np.int64) for c in ("n", "size", "block"))
    p, zero = _shares(n, size), _shares(np.zeros_like(n), size)
    i, j = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    sums = np.zeros((len(names), len(names)), np.int64)
    step = max(1, CELLS // max(1, len(right) * bits.shape[1]))
    for at in range(0, len(left), step):
        rows = left[at:at + step]
        cell = np.bitwise_count(bits[rows][:, None] & bits[right][None]).sum(2, dtype=np.int64)
        cell[source[rows][:, None] == source[right][None]] = 0
        x, y = np.nonzero(cell)
        count, x, y = cell[x, y], rows[x], right[y]
        value = distance(p[x], p[y]) - distance(p[x], zero[y]) - distance(zero[x], p[y]) + distance(zero[x], zero[y])
        np.add.at(sums, (source[x], source[y]), count * value)
    x, y = np.nonzero(sums)
    return pd.DataFrame({"lang": frame["lang"].iloc[0], "source": names[x], "item": names[y], "value": sums[x, y]})


def _f(p: str, q: str) -> Column:
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})")


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the language, and the first ``top`` terms, of each source."""
    counts = stored(term_counts(docs, lang, source, text))
    cells = stored(kept_cells(counts, least))
    languages = cells.select("lang", "term", "total").distinct().groupBy(F.col("lang").alias("l")).agg(
        F.count("*").alias("terms"), F.sum("total").alias("of_lang"))
    used = cells.groupBy(F.col("lang").alias("lu"), F.col("source").alias("su")).agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    groups = counts.filter("term = ''").select("lang", "source")
    groups = groups.join(used, (F.col("lang") == F.col("lu")) & (F.col("source") == F.col("su")), "left")
    groups = groups.join(languages, F.col("lang") == F.col("l"), "left").select(
        "lang", "source", _group("lang", "source").alias("g"), F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("terms", F.lit(0)).alias("terms"),
        F.greatest(F.coalesce("total", F.lit(0)) + F.coalesce("terms", F.lit(0)), F.lit(1)).alias("size"),
        (F.coalesce("of_lang", F.lit(0)) + F.coalesce("terms", F.lit(0))).alias("lang_size"),
        F.ceil(F.count("*").over(Window.partitionBy("lang")) / SOURCES).cast("int").alias("blocks"),
    )
    groups = stored(groups.withColumn("zero", share(F.lit(0), F.col("size"))))

    bitmaps = level_bitmaps(cells).withColumn("g", _group("lang", "source"))
    sized = lookup_join(bitmaps, groups.select("g", "size", "blocks"), "g", "inner")
    sized = sized.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    tiles = F.expr("explode(array_distinct(flatten(transform(sequence(0, blocks - 1), x -> array(struct(block as i, x as j), struct(x as i, block as j))))))")
    tiled = sized.select("lang", "chunk", "source", "n", "bits", "size", "block", tiles.alias("tile")).select("*", "tile.i", "tile.j").drop("tile")
    joint = tiled.groupBy("lang", "chunk", "i", "j").applyInPandas(_joint, "lang string, source string, item string, value long")

    # Complements: each level of a source against zero in every other, and zero against zero.
    other = groups.select(F.col("lang").alias("l"), F.col("source").alias("item"), F.col("zero").alias("item_zero"), F.col("own").alias("item_own"))
    levels = cells.groupBy("lang", "source", "n").agg(F.count("*").alias("count")).withColumn("g", _group("lang", "source"))
    levels = lookup_join(levels, groups.select("g", "size"), "g", "inner").withColumn("p", share(F.col("n"), F.col("size")))
    met = levels.join(other, (F.col("lang") == F.col("l")) & (F.col("source") != F.col("item")))
    one_zero = met.select("lang", F.explode(F.array(
        F.struct(F.col("source"), F.col("item"), (F.col("count") * _f("p", "item_zero")).alias("value")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (F.col("count") * _f("item_zero", "p")).alias("value")),
    )).alias("x")).select("lang", "x.source", "x.item", "x.value")
    both = groups.join(other, (F.col("lang") == F.col("l")) & (F.col("source") != F.col("item")))
    both = both.select("lang", "source", "item", ((F.col("terms") - F.col("own") - F.col("item_own")) * _f("zero", "item_zero")).alias("value"))
    pairs = joint.unionByName(one_zero).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    held = lookup_join(cells.withColumn("g", _group("lang", "source")), groups.select("g", "size", "lang_size"), "g", "inner")
    held = held.withColumn("p", share(F.col("n"), F.col("size"))).withColumn("q", share(F.col("total"), F.col("lang_size")))
    terms = held.filter("p > q").select("lang", "source", F.col("term").alias("item"), _f("p", "q").alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    ranked = pairs.withColumn("part", F.lit("pair")).withColumn("rank", rank).select(*columns)
    first = terms.withColumn("part", F.lit("term")).withColumn("rank", rank).filter(F.col("rank") <= top).select(*columns)
    return ranked.unionByName(first)
