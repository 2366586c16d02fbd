"""Substring dedup by level-wise doubling.

A window of ``size`` words whose word sequence also starts earlier (in a smaller
doc_id, or before in the same document) is a repeat; every word inside a repeat
is removed. Windows are judged on the input.

Levels: every window has an anchor, the start inside it whose short window of
``start`` words has the least hash. Equal windows have equal anchors, so short
windows are compared at anchors alone, about one word in six. Those that repeat
are candidates and are compared at twice the length around their anchor, and so
on, until none survives or the full windows of the survivors are compared.

Each level is one shuffle by the window's hash. A task first orders its own
windows and keeps the earliest of each; the others are known to repeat and travel
under a hash of their place, so a passage that a third of all documents hold is
one row per task at its hash. Sorted partitions are read as a stream.

Texts that are equal as a whole are found first, by their digest: the copies are
repeats from end to end and take no part in the levels.

Full windows are compared by 96 hash bits. Defined cases: null and empty texts
have no words and give the digest of the empty string; texts below ``size``
words lose nothing, copies included; a null doc_id counts as smaller than any
other; rows that repeat doc_id and text don't make each other repeats; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from vitalscope.operators.skew import lookup_join

from .common import Words, blocks, mix, stored, window_hashes

SIZE, START = 20, 10
NO_ID = -(2**63)
FLUSH = 1_500_000  # windows that a task orders at once
FEW_GROUPS = 200_000  # groups of equal texts that are broadcast, about 40 bytes each
_PLACE = np.uint64(0x9E3779B97F4A7C15)


def _sliding_first_least(values: np.ndarray, width: int) -> np.ndarray:
    """For every start, the position of the least of ``width`` values, the first at a tie."""
    n = len(values)
    best, have = np.arange(n), 1
    while have < width:
        step = min(have, width - have)
        other = best[np.minimum(np.arange(n) + step, n - 1)]
        # Near the end a range is cut short; such starts are not used.
        best = np.where(values[other] < values[best], other, best)
        have += step
    return best


def anchored(hashed: np.ndarray, limit: np.ndarray, size: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows, anchors): the starts of all full windows and the start of each one's anchor.

    ``limit`` is the end of the text of every word.
    """
    windows = np.flatnonzero(np.arange(len(hashed)) + size <= limit)
    if not len(windows):
        return windows, windows
    short = window_hashes(hashed, start)
    return windows, _sliding_first_least(short, size - start + 1)[windows]


def _level_start(windows: np.ndarray, anchors: np.ndarray, size: int, length: int) -> np.ndarray:
    """Where a window's part of ``length`` words starts: at the anchor, or as late as the window allows."""
    return np.minimum(anchors, windows + size - length)


def _unpack(column) -> pa.Array:
    if pa.types.is_binary(column.type):
        tool = zstandard.ZstdDecompressor()
        return pa.array([tool.decompress(x.as_py()) for x in column], pa.large_binary()).cast(pa.large_string())
    return column


def _pack(batches):
    tool = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = pa.array([tool.compress((x.as_py() or "").encode()) for x in batch.column(1)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), packed, batch.column(2)], ["doc_id", "text", "copy"])


def _texts(batches):
    """(doc ids, texts, survivors or None) of blocks; survivors are sorted starts per text."""
    for batch in batches:
        ids, more = batch.column(0), batch.column(2) if batch.num_columns > 2 else None
        for at, texts in blocks(_unpack(batch.column(1))):
            yield ids.slice(at, len(texts)).to_numpy(zero_copy_only=False), texts, None if more is None else more.slice(at, len(texts))


def _members(starts: np.ndarray, doc: np.ndarray, first: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Which of the ``starts`` (in texts ``doc``) are in their text's list."""
    lists = lists.fill_null([]) if lists.null_count else lists
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(lists.offsets.to_numpy())
    owner = np.repeat(np.arange(len(lists)), sizes)
    place = first[owner] + values
    place = np.sort(place[place < first[owner + 1]])
    at = np.searchsorted(place, starts)
    return (at < len(place)) & (place[np.minimum(at, max(len(place) - 1, 0))] == starts) if len(place) else np.zeros(len(starts), bool)


def _emit(size: int, start: int, length: int):
    """Windows of ``length`` words as rows (h, x, doc).

    x holds 32 more hash bits, the place in its text and whether the window is
    known to repeat; for those h is a hash of the place. Below the full length
    only windows at survivors of the level before are sent.
    """
    def flush(parts):
        h, more, doc, pos = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((pos, doc, more, h))
        h, more, doc, pos = h[order], more[order], doc[order], pos[order]
        head = np.ones(len(h), bool)
        head[1:] = (h[1:] != h[:-1]) | (more[1:] != more[:-1])
        lead = np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))
        same = (doc == doc[lead]) & (pos == pos[lead])  # a repeated row is no repeat of itself
        known = ~same
        if length < size:  # a candidate survives wherever it stands, its first place too
            group = np.cumsum(head) - 1
            known = np.bincount(group, minlength=head.sum())[group] > 1
        rows = np.concatenate([np.flatnonzero(head), np.flatnonzero(known)])
        sure = np.arange(len(rows)) >= head.sum()
        h, more, doc, pos = h[rows], more[rows], doc[rows], pos[rows]
        h = np.where(sure, mix(doc.astype(np.uint64) * _PLACE + pos.astype(np.uint64)), h)
        x = (more.astype(np.uint64) << np.uint64(32)) | (pos.astype(np.uint64) << np.uint64(1)) | sure.astype(np.uint64)
        return pa.RecordBatch.from_arrays(
            [pa.array(h.view(np.int64)), pa.array(x.view(np.int64)), pa.array(doc)], ["h", "x", "doc_id"]
        )

    def run(batches):
        parts, count = [], 0
        for ids, texts, survivors in _texts(batches):
            w = Words(texts)
            doc = np.repeat(np.arange(len(texts)), np.diff(w.first))
            one = w.hashes()
            windows, anchors = anchored(one, w.first[1:][doc], size, start)
            if length > start and len(windows):  # the level before left these
                before = _level_start(windows, anchors, size, length // 2)
                fine = _members(before, doc, w.first, survivors)
                windows, anchors = windows[fine], anchors[fine]
            if not len(windows):
                continue
            at = np.unique(_level_start(windows, anchors, size, length)) if length < size else windows
            h = window_hashes(one, length)[at]
            if length < size:
                more = np.zeros(len(at), np.uint32)
            else:
                more = (window_hashes(w.hashes(1), length)[at] >> np.uint64(32)).astype(np.uint32)
            own = doc[at]
            parts.append((h, more, ids[own].astype(np.int64), at - w.first[own]))
            count += len(at)
            if count >= FLUSH:
                yield flush(parts)
                parts, count = [], 0
        if parts:
            yield flush(parts)
    return run


def _resolve(full: bool):
    """Rows sorted by (h, bits, doc, place) -> rows (doc_id, x) that repeat.

    ``full``: all but the earliest of a window; else every one of a window with several.
    """
    def run(batches):
        carry = None  # the last row, whether it is already out, and the first place of its window
        for batch in batches:
            if not batch.num_rows:
                continue
            h, x, doc = (batch.column(i).to_numpy() for i in range(3))
            bits, pos, sure = x >> 32, (x >> 1) & 0x7FFFFFFF, (x & 1) == 1
            head = np.ones(len(h), bool)
            head[1:] = (h[1:] != h[:-1]) | (bits[1:] != bits[:-1]) | sure[1:] | sure[:-1]
            out = sure.copy()
            extra = []
            joins = carry is not None and not sure[0] and (h[0], bits[0]) == carry["window"]
            if joins:
                head[0] = False
            if full:
                index = np.maximum.accumulate(np.where(head, np.arange(len(h)), -1))
                lead_doc, lead_pos = doc[np.maximum(index, 0)], pos[np.maximum(index, 0)]
                if joins:
                    lead_doc[index < 0], lead_pos[index < 0] = carry["doc"], carry["pos"]
                out |= ~head & ((doc != lead_doc) | (pos != lead_pos))
            else:
                follows = np.append(~head[1:], False)
                out |= ~head | follows
                if joins and not carry["out"]:
                    extra.append((carry["doc"], carry["x"]))
            last = None if sure[-1] else {"window": (h[-1], bits[-1]), "out": bool(out[-1]), "doc": doc[-1], "pos": pos[-1], "x": x[-1]}
            if full and last is not None:
                last["doc"], last["pos"] = lead_doc[-1], lead_pos[-1]
            if last is not None and not full and joins and not head.any():
                last["out"] = True
            carry = last
            docs = np.concatenate([doc[out], np.array([e[0] for e in extra], np.int64)])
            xs = np.concatenate([x[out], np.array([e[1] for e in extra], np.int64)])
            if len(docs):
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(xs)], ["doc_id", "x"])
    return run


def _level(rows: DataFrame, size: int, start: int, length: int) -> DataFrame:
    """doc_id and the sorted places (``length`` < ``size``) or marks that repeat at this length."""
    windows = rows.mapInArrow(_emit(size, start, length), "h long, x long, doc_id long")
    dealt = windows.repartition("h").sortWithinPartitions("h", F.shiftright("x", 32), "doc_id", "x")
    repeats = dealt.mapInArrow(_resolve(length == size), "doc_id long, x long")
    if length < size:
        value = F.shiftright("x", 1).bitwiseAND(0x7FFFFFFF).cast("int")
    else:  # the place, with hash bits that tell apart texts under one doc_id
        value = F.col("x")
    return repeats.groupBy("doc_id").agg(F.collect_set(value).alias("found"))


def _kept(size: int, full: bool):
    """(doc_id, n_words, n_removed, kept) per row; columns doc_id, text, found, copy."""
    def run(batches):
        for batch in batches:
            copies = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            base = 0
            for ids, texts, found in _texts([batch.select([0, 1, 2])]):
                w = Words(texts)
                n, words = len(texts), np.diff(w.first)
                cover = np.zeros(len(w) + 1, np.int64)
                if found.null_count < n:
                    lists = found.fill_null([]) if found.null_count else found
                    marks = lists.flatten().to_numpy(zero_copy_only=False)
                    owner = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
                    place = w.first[owner] + ((marks >> 1) & 0x7FFFFFFF)
                    inside = place + size <= w.first[owner + 1]
                    place, marks = place[inside], marks[inside]
                    bits = (window_hashes(w.hashes(1), size)[place] >> np.uint64(32)).astype(np.int64)
                    place = np.unique(place[bits == ((marks >> 32) & 0xFFFFFFFF)])
                    np.add.at(cover, place, 1)
                    np.add.at(cover, place + size, -1)
                removed = np.cumsum(cover)[:-1] > 0
                copy = copies[base:base + n] & (words >= size)
                removed |= np.repeat(copy, words)
                base += n
                yield _row_batch(ids, w, removed, full)
    return run


def _row_batch(ids: np.ndarray, w: Words, removed: np.ndarray, full: bool) -> pa.RecordBatch:
    """Kept words joined by one space, and their digests."""
    n, words = len(ids), np.diff(w.first)
    doc = np.repeat(np.arange(n), words)
    kept = np.flatnonzero(~removed)
    sizes = w.end[kept] - w.start[kept] + 1
    ends = np.cumsum(sizes)
    index = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - w.start[kept], sizes)
    # Every word with the byte after it; that byte becomes a space.
    data = np.append(w.data, np.uint8(32))[index] if len(index) else np.zeros(0, np.uint8)
    data[ends - 1] = 32
    reach = np.concatenate([[0], ends])[np.searchsorted(doc[kept], np.arange(n + 1))]
    raw = [data[a:max(a, b - 1)].tobytes() for a, b in zip(reach, reach[1:])]
    columns = [
        pa.array([None if i == NO_ID else int(i) for i in ids], pa.int64()), pa.array(words, pa.int64()),
        pa.array(np.bincount(doc[removed], minlength=n), pa.int64()),
        pa.array([r.decode() for r in raw], pa.string()) if full else pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept" if full else "kept_sha256"])


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, start: int = START, digests: bool = False,
) -> DataFrame:
    """doc_id, n_words, n_removed and the kept text (or its SHA-256) of every row.

    ``size`` must be ``start`` times a power of two.
    """
    if size % start or (size // start) & (size // start - 1):
        raise ValueError("size must be start times a power of two")
    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    groups = rows.groupBy(digest.alias("digest")).agg(F.min("doc_id").alias("__first"), F.max("doc_id").alias("__last"))
    groups = stored(groups.filter("__last > __first").select("digest", "__first"))
    marked = lookup_join(rows.withColumn("digest", digest), groups, "digest", max_rows=FEW_GROUPS)
    marked = marked.select("doc_id", "text", F.coalesce(F.col("doc_id") > F.col("__first"), F.lit(False)).alias("copy"))
    once = marked.filter(~F.col("copy"))
    packed = marked.mapInArrow(_pack, "doc_id long, text binary, copy boolean")
    length = start
    found = _level(once.select("doc_id", "text"), size, start, length)
    while length < size:
        length *= 2
        survivors = packed.filter(~F.col("copy")).select("doc_id", "text").join(found, "doc_id")
        found = _level(survivors, size, start, length)
    name = "kept_sha256" if digests else "kept"
    return packed.join(found, "doc_id", "left").select("doc_id", "text", "found", "copy").mapInArrow(
        _kept(size, not digests), f"doc_id long, n_words long, n_removed long, {name} string"
    )
