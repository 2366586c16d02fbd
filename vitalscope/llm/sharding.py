"""Sharding by extendible hashing, in DataFrame functions only.

Every row gets a 60-bit hash. The root bucket holds everything; a bucket above
the byte limit splits on the next hash bit and one that fits is a shard. The
splits of ``STEP`` bits are counted together in one pass over the rows of the
oversized buckets, so a pass reads only what is still too large, and the number
of passes follows log2(total bytes / limit). Bucket tables have at most
``2 ** (STEP + 1)`` rows for each oversized bucket, of which there are fewer than
total bytes / limit. The directory itself is kept as shards. A row finds its shard by a few
leading bits of its hash and the shard's range of hashes; the directory is broadcast after a count, and
texts are shuffled once, on their way to their shards.

Defined cases: null text has 0 bytes; a null key hashes as the word ``null``;
equal rows are told apart by a copy number, so a key that holds a third of all
rows spreads like any other; one row above the limit is a shard of its own
(``shard_bytes`` tells); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from vitalscope.operators.skew import lookup_join
from vitalscope.session import checkpoint_dir, is_small, small_side

from .common import fresh, stored

BITS = 60
STEP = 8
DIRECTORY_ROWS = 100_000  # of 60 bytes or so, that are broadcast
FACTS = ("depth", "prefix", "shard_bytes", "shard_rows")


def _hash(text: Column) -> Column:
    """The first 60 bits of the MD5 digest."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _hashed() -> Column:
    return _hash(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "bytes", "copy"))


def _prefix(level: str | int) -> Column:
    return F.expr(f"shiftright(__h, {BITS} - {level})")


def keyed(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Slim rows (doc_id, copy, bytes, hash); equal rows are counted before any shuffle."""
    slim = df.select(
        F.col(f"`{key}`").alias("doc_id"),
        F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long").alias("bytes"),
    )
    counted = slim.groupBy("doc_id", "bytes").agg(F.count("*").alias("__n"))
    copies = counted.select("doc_id", "bytes", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))).alias("copy"))
    return copies.withColumn("__h", _hashed())


def directory(slim: DataFrame, limit: int) -> DataFrame:
    """depth, prefix, shard_bytes, shard_rows of every shard."""
    found, rows, base = None, slim, 0
    while base < BITS:
        top = min(base + STEP, BITS)
        cells = rows.groupBy(_prefix(top).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"))
        nodes = (
            cells.select(F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth"), "cell", "bytes", "rows")
            .groupBy("depth", F.expr(f"shiftright(cell, {top} - depth)").alias("prefix"))
            .agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
            .withColumn("fits", (F.col("bytes") <= limit) | (F.col("rows") == 1) | (F.col("depth") == BITS))
        )
        nodes = stored(nodes)
        above = nodes.filter(~F.col("fits")).select(
            (F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix")
        )
        fit = nodes.filter("fits")
        shards = fit.join(above, ["depth", "prefix"], "left_semi")
        if base == 0:
            shards = shards.unionByName(fit.filter("depth = 0"))
        else:  # the top nodes of a later pass are the oversized buckets themselves
            shards = shards.filter(F.col("depth") > base)
        shards = shards.select("depth", "prefix", F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows"))
        found = shards if found is None else found.unionByName(shards)
        large = nodes.filter(~F.col("fits") & (F.col("depth") == top)).select(F.col("prefix").alias("__large"))
        if large.isEmpty():
            break
        rows = slim.join(small_side(large, DIRECTORY_ROWS), _prefix(top) == F.col("__large"), "left_semi")
        base = top
    return stored(found)


def assign(df: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, copy, bytes, depth, prefix, shard_bytes, shard_rows.

    A shard is named by ``depth`` hash bits with the value ``prefix``.
    """
    slim = stored(keyed(df, key, text))
    return _placed(slim, directory(slim, limit))[0].select("doc_id", "copy", "bytes", *FACTS)


def _placed(rows: DataFrame, shards: DataFrame) -> tuple[DataFrame, bool]:
    """``rows`` (with the hash __h) and the shard of each; true where the directory was small enough to be sent to all.

    If not, the join by leading bits puts all rows of a shard into one partition. Leading bits are as many
    as tell the shards apart on average; a shard above them has a row for each of its cells, fewer than there are shards.
    """
    bits = min(BITS, max(0, shards.count() - 1).bit_length())
    cells = F.expr(f"sequence(shiftleft(prefix, greatest({bits} - depth, 0)), shiftleft(prefix + 1, greatest({bits} - depth, 0)) - 1)")
    ranges = shards.select(
        F.explode(F.when(F.col("depth") <= bits, cells).otherwise(F.array(F.expr(f"shiftright(prefix, depth - {bits})")))).alias("__cell"),
        F.expr(f"shiftleft(prefix, {BITS} - depth)").alias("__low"), F.expr(f"shiftleft(prefix + 1, {BITS} - depth)").alias("__high"), *FACTS,
    )
    small = is_small(ranges, DIRECTORY_ROWS)
    match = (F.shiftright("__h", BITS - bits) == F.col("__cell")) & (F.col("__h") >= F.col("__low")) & (F.col("__h") < F.col("__high"))
    return rows.join(F.broadcast(ranges) if small else ranges, match).select(*rows.columns, *FACTS), small


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, bytes, row) with the copy number of each among the rows of its doc_id and bytes.

    Only repeated rows are numbered, in chunks of 65,536 places of the table, so no
    task gets a whole hot key. They are stored first, so that a lost task can't renumber them.
    """
    tagged = rows.withColumn("tag", F.xxhash64("doc_id", "bytes"))
    repeated = stored(tagged.groupBy("tag", "doc_id", "bytes").count().filter("count > 1").select("tag").distinct())
    alone = lookup_join(tagged, repeated, "tag", "left_anti").withColumn("copy", F.lit(1))
    again = lookup_join(tagged, repeated, "tag", "left_semi").withColumn("at", F.monotonically_increasing_id())
    again = stored(again.withColumn("chunk", F.shiftright("at", 16)))
    group = ("tag", "doc_id", "bytes")
    before = Window.partitionBy(*group).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = again.groupBy(*group, "chunk").count().withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0)))
    offsets = offsets.select(*[F.col(c).alias(f"__{c}") for c in (*group, "chunk")], "offset")
    within = F.row_number().over(Window.partitionBy(*group, "chunk").orderBy("at"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*group, "chunk")]
    numbered = again.withColumn("number", within).join(offsets, same).withColumn("copy", (F.col("offset") + F.col("number")).cast("int"))
    return alone.select("doc_id", "bytes", "row", "copy").unionByName(numbered.select("doc_id", "bytes", "row", "copy"))


def write_shards(df: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text", copy: str | None = None) -> None:
    """Write every row of ``df`` into the folder of its shard, one file each.

    Equal rows go each to the shard of its own copy number, which a column ``copy`` can keep.
    """
    slim = stored(keyed(df, key, text))
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long")
    rows = _numbered(df.select(F.col(f"`{key}`").alias("doc_id"), size.alias("bytes"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")))
    placed, spread = _placed(rows.withColumn("__h", _hashed()), directory(slim, limit))
    (shard,) = fresh(df, "shard")
    kept = [F.col("copy").alias(copy)] if copy else []
    out = placed.select("row.*", *kept, F.concat_ws("-", "depth", "prefix").alias(shard))
    (out.repartition(shard) if spread else out).write.partitionBy(shard).parquet(path)


def written(df: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Like ``assign``, from the shards as they were written: the sums are those of the rows in each folder."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    copy, shard = fresh(df, "copy", "shard")
    write_shards(df, path, limit, key, text, copy)
    schema = StructType([df.schema[key], df.schema[text], StructField(copy, IntegerType()), StructField(shard, StringType())])
    rows = spark.read.schema(schema).parquet(path)
    part = F.split(F.col(shard), "-")
    rows = rows.select(
        F.col(f"`{key}`").alias("doc_id"), F.col(copy).alias("copy"),
        F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long").alias("bytes"),
        part[0].cast("int").alias("depth"), part[1].cast("long").alias("prefix"),
    )
    sums = rows.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.count("*").alias("shard_rows"))
    return rows.join(small_side(sums), ["depth", "prefix"]).select("doc_id", "copy", "bytes", *FACTS)
