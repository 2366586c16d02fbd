"""Shared pieces: stored intermediate tables, words of a batch and their hashes."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from vitalscope.session import checkpoint_dir

# Texts are worked on in blocks of about this many bytes, so that a task's
# memory does not follow the size of an Arrow batch.
BLOCK_BYTES = 1 << 21
# Where the distinct words of a block are looked at once each, larger blocks hold fewer.
LARGE_BLOCK = 1 << 24
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, so a lost executor costs no recomputation, and lets
    several later jobs read the rows without computing them again. The shuffle files behind
    it go as soon as it is written, not when the driver happens to collect its garbage.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, and what its task freed goes back to the system: workers that wait for later tasks hold little."""
    def out(batches):
        yield from run(batches)
        batches = None
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
        if trim:
            trim(0)
    return out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that ``df`` has already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def with_id(df: DataFrame, key: str, text: str) -> DataFrame:
    """Columns ``doc_id`` (long) and ``text`` (null kept) under fixed names."""
    return df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, (2, 256), dtype=np.uint64)
_STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_BACK = tuple(np.uint64(pow(int(s), -1, 2**64)) for s in _STEP)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts as byte ranges.

    ``start``/``end`` are byte ranges in ``data``; the words of text ``i`` are
    ``first[i]:first[i + 1]``. Only bytes are looked at: white space is below
    0x80, so no byte of a longer UTF-8 sequence is taken for it.
    """

    def __init__(self, texts: pa.Array, lower: bool = False) -> None:
        texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.data = LOWER[data] if lower else data
        bounds = offsets - offsets[0]
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = ~_SPACE[data]
        turns = np.diff(inside)
        # A text's first byte starts a word even if the text before it has no space at its end.
        cut = bounds[(bounds > 0) & (bounds < len(data))]
        cut = np.unique(cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]) if len(cut) else cut
        self.start = np.flatnonzero(turns == 1)
        self.end = np.flatnonzero(turns == -1)
        if len(cut):
            self.start = np.sort(np.concatenate([self.start, cut]))
            self.end = np.sort(np.concatenate([self.end, cut]))
        self.first = np.searchsorted(self.start, bounds)
        self.bounds = bounds

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes; ``which`` picks one of two independent ones."""
        powers, back = _powers(which, len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[which][self.data] * powers[:len(self.data)], out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * back[self.start]
        return mix(h + (self.end - self.start).astype(np.uint64))


class _Kept(dict):
    """What a process keeps for itself: functions that are sent to tasks take none of it along."""

    def __reduce__(self):
        return _Kept, ()


def _powers(which: int, n: int, _kept: dict = _Kept()) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a multiplier and of its inverse, kept for blocks of the usual size."""
    if which in _kept and len(_kept[which][0]) >= n:
        return _kept[which]
    tables = []
    for factor in (_STEP[which], _BACK[which]):
        powers = np.empty(max(n, BLOCK_BYTES + 1), np.uint64)
        powers[0] = 1
        np.cumprod(np.full(len(powers) - 1, factor), out=powers[1:])
        tables.append(powers)
    if n <= 4 * BLOCK_BYTES:
        _kept[which] = tuple(tables)
    return tuple(tables)


SPACES = " \t\n\x0b\x0c\r"
_K = np.uint64(0xD6E8FEB86659FD93)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Order-sensitive hash of ``size`` words from every position (doubling steps).

    Positions with fewer than ``size`` words left hold no meaning.
    """
    bits = bin(size)[2:]
    acc, have = words.copy(), 1
    for bit in bits[1:]:
        nxt = np.zeros_like(acc)
        nxt[:max(0, len(acc) - have)] = acc[have:]
        acc, have = mix(acc * np.uint64(pow(int(_K), have, 2**64)) + nxt), 2 * have
        if bit == "1":
            nxt = np.zeros_like(acc)
            nxt[:max(0, len(acc) - have)] = words[have:]
            acc, have = mix(acc * _K + nxt), have + 1
    return acc


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts cut before every white space that follows a word: (pieces, pieces per text).

    A piece is white space and a word; a text's first may lack the space, its
    last the word. The pieces share the texts' memory.
    """
    words = Words(texts)
    starts = np.union1d(words.end, words.bounds)
    counts = np.diff(np.searchsorted(starts, words.bounds))
    data = pa.py_buffer(words.data)
    return pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), data]), counts


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES):
    """Slices ``(start, texts)`` of about ``limit`` bytes; one longer text stays whole."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        to = min(to, len(texts))
        yield at, texts.slice(at, to - at)
        at = to


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of the ranges that begin at ``starts``, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)


class Vocabulary:
    """The pieces of a block as numbers: ``words[unit[i]]`` is the i-th word, without white space.

    The words of text ``i`` are the positions ``first[i]:first[i + 1]``; ``doc`` names each position's text.
    """

    def __init__(self, texts: pa.Array) -> None:
        pieces, counts = units(texts)
        coded = pieces.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        known: dict[str, int] = {}
        place = np.array([known.setdefault(p.strip(SPACES), len(known)) for p in coded.dictionary.to_pylist()], np.int64)
        doc = np.repeat(np.arange(len(counts)), counts)
        unit = place[index] if len(index) else index
        if "" in known:  # white space at the end of a text
            fine = unit != known[""]
            unit, doc = unit[fine], doc[fine]
        self.words, self.unit, self.doc = list(known), unit, doc
        self.first = np.searchsorted(doc, np.arange(len(counts) + 1))
