"""WARC archives of Zstandard frames: written and read with Spark's own files.

An archive starts with a skippable frame that holds the dictionary; then comes
one frame per record. Spark's text writer writes the frames as rows. Its line
separator is an empty skippable frame, which a Zstandard reader passes over, so
the files are plain ``.warc.zst`` data and commits are Spark's. A new file begins
after ``RECORDS`` rows, and the writer sends the dictionary at those very rows.

Equal payloads of at least ``least`` bytes are kept once: the largest page_id
holds the response, the others are revisit records that refer to it.

Defined cases: null html is an empty payload; pages with equal page_id and
payload are each written, all responses or all revisits; a null page_id counts
as smaller than any other; an empty table gives no rows; other columns are
ignored. A damaged archive raises ValueError with its file name.
"""

from __future__ import annotations

import base64
import hashlib
import string
import struct
import uuid
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from vitalscope.session import checkpoint_dir, is_small

from .common import stored

DICT_MAGIC = 0x184D2A5D
GAP = struct.pack("<II", 0x184D2A50, 0)  # an empty skippable frame
RECORDS = 2048  # rows of a file, its dictionary included
DICT_SAMPLE = 400  # pages the dictionary is trained on
DICT_BYTES = 32 << 10
NO_ID = -(2**63)
FEW_GROUPS = 200_000  # groups of equal payloads that are broadcast, about 60 bytes each


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train_dictionary(pages: DataFrame, html: str = "html", rows: int = DICT_SAMPLE) -> bytes:
    """A dictionary from at most ``rows`` pages; empty where there is too little to learn from."""
    sample = [
        (r[0] or "")[:20_000].encode() for r in pages.select(F.col(f"`{html}`").cast("string")).limit(rows).collect()
    ]
    try:
        return zstandard.train_dictionary(DICT_BYTES, [s for s in sample if s]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers: int | None) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP headers, not the body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers is None else "revisit"
    block = http + payload if refers is None else http
    uri = quote(url or "", safe=string.punctuation)
    head = [
        "WARC/1.1", f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{uri}|{sha}')}>",
        "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {uri}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
        f"WARC-Payload-Digest: sha1:{sha}", f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To-Page-ID: {refers}",
        ]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decided(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url", least: int = 0) -> DataFrame:
    """Columns page_id, url, html and ``refers`` (null: response).

    Only digests that occur under several page_ids are joined back, counted before
    the shuffle; a digest that a third of all pages share is one row there, and
    its pages are spread by a salt.
    """
    raw = pages.select(
        F.col(f"`{key}`").cast("long").alias("page_id"),
        (F.col(f"`{url}`").cast("string") if url in pages.columns else F.lit(None).cast("string")).alias("url"),
        F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("html"),
    )
    sha = F.sha1(F.col("html").cast("binary"))
    number = F.coalesce("page_id", F.lit(NO_ID))
    slim = raw.select(sha.alias("__sha"), number.alias("__id"), F.octet_length("html").alias("__len"))
    groups = (
        slim.filter(F.col("__len") >= least).groupBy("__sha")
        .agg(F.max("__id").alias("__last"), F.min("__id").alias("__low")).filter("__last > __low")
    )
    groups = stored(groups.select("__sha", "__last"))
    rows = raw.withColumn("__sha", sha)
    if is_small(groups, FEW_GROUPS):
        joined = rows.join(F.broadcast(groups), "__sha", "left")
    else:  # pages outside such groups meet nothing; the salt deals a hot group out to 16 tasks
        salted = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        salt = F.pmod(F.xxhash64("page_id"), F.lit(16)).cast("int")
        joined = rows.withColumn("__salt", salt).join(salted, ["__sha", "__salt"], "left")
    return joined.select(
        "page_id", "url", "html", F.when(F.col("__last") > F.coalesce("page_id", F.lit(NO_ID)), F.col("__last")).alias("refers")
    )


def _frames(dictionary: bytes):
    def run(batches):
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=3, dict_data=trained, write_content_size=True, write_checksum=True)
        lead = struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary
        rows = 0
        for batch in batches:
            out = []
            for page, url, html, refers in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if rows % RECORDS == 0:
                    out.append(lead)
                    rows += 1
                payload = html.encode()
                out.append(pack.compress(record(page, url, payload, digest(payload), refers)))
                rows += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
    return run


def write(pages: DataFrame, path: str, key: str = "page_id", html: str = "html", url: str = "url", least: int = 0) -> None:
    """Write a record per page below ``path``."""
    frames = decided(pages, key, html, url, least).mapInArrow(_frames(train_dictionary(pages, html)), "frame binary")
    (frames.select(F.col("frame").cast("string").alias("value")).write
     .option("lineSep", GAP.decode("latin-1")).option("maxRecordsPerFile", RECORDS).text(path))


def split_frames(data: bytes) -> tuple[bytes, list[bytes]]:
    """The dictionary and the frames of an archive; skippable frames are passed over."""
    at, dictionary, frames = 0, b"", []
    view = memoryview(data)
    while at < len(data):
        if len(data) - at < 8:
            raise ValueError("the archive ends inside a frame header")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if at + 8 + size > len(data):
                raise ValueError("a skippable frame runs over the end")
            if magic == DICT_MAGIC:
                if at:
                    raise ValueError("the dictionary is not at the start")
                dictionary = bytes(view[8:8 + size])
            at += 8 + size
            continue
        if magic != 0xFD2FB528:
            raise ValueError(f"no frame at byte {at}")
        end = at + _frame_size(view, at)
        frames.append(bytes(view[at:end]))
        at = end
    return dictionary, frames


def _frame_size(view: memoryview, at: int) -> int:
    """Bytes of the frame at ``at``, from its block headers."""
    flags = view[at + 4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    sizes = (flags >> 6, (0, 1, 2, 4)[flags & 3])
    content = (1 if single else 0) if sizes[0] == 0 else 1 << sizes[0]
    pos = at + 5 + (0 if single else 1) + sizes[1] + content
    while True:
        if pos + 3 > len(view):
            raise ValueError("a frame runs over the end")
        head = view[pos] | view[pos + 1] << 8 | view[pos + 2] << 16
        pos += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    pos += 4 * checksum
    if pos > len(view):
        raise ValueError("a frame runs over the end")
    return pos - at


def parse(raw: bytes) -> tuple[int | None, int, str, str, int | None, bytes]:
    """(page_id, payload_bytes, payload_digest, type, refers_to, payload) of a record, checked."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("ascii").split("\r\n")
    if not gap or lines[0] != "WARC/1.1":
        raise ValueError("no WARC header")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    length = int(fields["Content-Length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("the block length differs from Content-Length")
    block = rest[:length]
    if fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise ValueError("the block digest differs")
    http, gap, body = block.partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/1.1 "):
        raise ValueError("no HTTP header")
    size = int(http.decode("ascii").rpartition("Content-Length: ")[2].split("\r\n")[0])
    kind, sha = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    page = fields["WARC-Page-ID"].strip()
    if kind == "response" and (len(body) != size or digest(body) != sha):
        raise ValueError("the payload differs from its digest or length")
    if kind == "revisit" and body:
        raise ValueError("a revisit has a payload")
    refers = int(fields["WARC-Refers-To-Page-ID"]) if kind == "revisit" else None
    return (int(page) if page else None), size, sha, kind, refers, body


def _unpacked(payload: bool):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payload
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payload

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    dictionary, frames = split_frames(data.as_py())
                    trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
                    unpack = zstandard.ZstdDecompressor(dict_data=trained)
                    for at in range(0, len(frames), 256):
                        rows = [parse(unpack.decompress(f)) for f in frames[at:at + 256]]
                        columns = list(zip(*rows))[:len(names)]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
                except (ValueError, KeyError, zstandard.ZstdError) as error:
                    raise ValueError(f"{name}: {error}") from error
    return run


def read(spark, path: str, payload: bool = False) -> DataFrame:
    """The records of all archives below ``path``; every frame, header, length and digest is checked."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    # An archive is one row; smaller Arrow batches keep few of them in memory.
    return files.mapInArrow(_unpacked(payload), schema + ", payload binary" * payload)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archive ``pages`` in the shared folder and read the records back."""
    path = f"{checkpoint_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(pages, path, least=least)
    return read(pages.sparkSession, path)
