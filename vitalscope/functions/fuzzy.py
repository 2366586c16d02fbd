"""Spelling repair against a short ordered vocabulary.

A repair depends on the word alone, so it runs inside the scan stage: no
shuffle, no table of repairs to join back. Each Arrow batch is dictionary
encoded and only words the task has not met are scored.
"""

from __future__ import annotations

import difflib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

# Words a task remembers before it starts afresh.
MEMORY_WORDS = 1 << 17
# Tokens of a batch looked at together; a longer row stays whole.
PART_TOKENS = 1 << 17
# Characters of the texts that are normalized together; a longer text stays whole.
PART_CHARS = 1 << 20
# Letter counts compared at once: words times terms times 27.
COMPARED = 1 << 22

_MATCH = StructType([StructField("term", StringType()), StructField("score", DoubleType())])


def _letter_counts(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter counts per word (a-z, then all other characters) and lengths."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    slots = np.where((codes >= 97) & (codes < 123), codes.astype(np.int64) - 97, 26)
    rows = np.repeat(np.arange(len(words)), lengths)
    counts = np.bincount(rows * 27 + slots, minlength=len(words) * 27).reshape(len(words), 27)
    return counts.astype(np.int16), lengths


def _chunk(terms: int) -> int:
    """How many words are compared with all terms at once."""
    return max(1, COMPARED // (27 * max(1, terms)))


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    previous = [0] * (len(b) + 1)
    for char in a:
        current = [0]
        for j, other in enumerate(b):
            current.append(
                previous[j] + 1 if char == other else max(previous[j + 1], current[j])
            )
        previous = current
    return previous[-1]


def indel_ratio(a: str, b: str) -> float:
    """Similarity in percent: 200 * LCS / (len a + len b)."""
    total = len(a) + len(b)
    return 200.0 * common_subsequence(a, b) / total if total else 100.0


class TermMatcher:
    """Best term at or above ``threshold`` percent; the first term wins ties."""

    def __init__(self, terms: list[str], threshold: float = 80.0, untouched=(), shortest: int = 3):
        self.terms = list(terms)
        self.threshold = threshold
        self.untouched = frozenset(untouched)
        self.shortest = shortest
        self.letters, self.lengths = _letter_counts(self.terms)

    def __call__(self, words: list[str]) -> list[tuple[str, float] | None]:
        found: list[tuple[str, float] | None] = [None] * len(words)
        index = [
            i for i, w in enumerate(words) if len(w) >= self.shortest and w not in self.untouched
        ]
        step = _chunk(len(self.terms))
        for start in range(0, len(index), step):
            self._match(words, index[start:start + step], found)
        return found

    def _match(self, words, index, found) -> None:
        if not index:
            return
        letters, lengths = _letter_counts([words[i] for i in index])
        total = lengths[:, None] + self.lengths[None, :]
        # Shared letters bound the common subsequence from above: exact pruning.
        shared = np.minimum(letters[:, None, :], self.letters[None, :, :]).sum(axis=2)
        bound = 200.0 * shared / total
        for row in np.flatnonzero((bound >= self.threshold).any(axis=1)):
            word, best = words[index[row]], None
            for col in np.flatnonzero(bound[row] >= self.threshold):
                score = indel_ratio(word, self.terms[col])
                if score >= self.threshold and (best is None or score > best[1]):
                    best = (self.terms[col], score)
            found[index[row]] = best


class CloseMatcher:
    """Best match by matching-blocks ratio, as the standard library ranks it."""

    def __init__(self, terms: list[str], cutoff: float = 0.8):
        self.terms = list(terms)
        self.cutoff = cutoff
        self.letters, self.lengths = _letter_counts(self.terms)

    def __call__(self, words: list[str]) -> list[tuple[str, float] | None]:
        found: list[tuple[str, float] | None] = [None] * len(words)
        step = _chunk(len(self.terms))
        for start in range(0, len(words), step):
            part = words[start:start + step]
            letters, lengths = _letter_counts(part)
            total = np.maximum(lengths[:, None] + self.lengths[None, :], 1)
            shared = np.minimum(letters[:, None, :], self.letters[None, :, :]).sum(axis=2)
            possible = 2.0 * shared / total >= self.cutoff
            for row in np.flatnonzero(possible.any(axis=1)):
                terms = [self.terms[c] for c in np.flatnonzero(possible[row])]
                best = difflib.get_close_matches(part[row], terms, n=1, cutoff=self.cutoff)
                if best:
                    ratio = difflib.SequenceMatcher(None, best[0], part[row]).ratio()
                    found[start + row] = (best[0], ratio)
        return found


class _Remembered:
    """Calls ``matcher`` only for words this task has not met yet."""

    def __init__(self, matcher):
        self.matcher = matcher
        self.memory: dict[str, tuple[str, float] | None] = {}

    def __call__(self, words: list[str]) -> list[tuple[str, float] | None]:
        fresh = [w for w in dict.fromkeys(words) if w not in self.memory]
        if len(self.memory) + len(fresh) > MEMORY_WORDS:
            self.memory = {}
            fresh = list(dict.fromkeys(words))
        self.memory.update(zip(fresh, self.matcher(fresh)))
        return [self.memory[w] for w in words]


def row_parts(tokens: pa.Array):
    """Slices of whole rows with at most PART_TOKENS tokens each; a longer row is a slice of its own."""
    ends = np.cumsum(tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + PART_TOKENS, "right")))
        yield tokens.slice(start, stop - start)
        start = stop


def text_parts(texts: pa.Array, size: int | None = None):
    """Slices of whole texts with about PART_CHARS (or ``size``) bytes each; a longer text is a slice of its own."""
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    ends, start, size = np.cumsum(sizes, dtype=np.int64), 0, size or PART_CHARS
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield texts.slice(start, stop - start)
        start = stop


def split_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(different words, numbers of all words, first word of every text and the end): the texts cut as ``str.split`` does."""
    split = pc.utf8_split_whitespace(texts)
    ends = np.concatenate([[0], np.cumsum(split.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if "" in words:  # white space at the end of a text
        empty = words.index("")
        fine = number != empty
        ends = np.concatenate([[0], np.cumsum(fine)])[ends]
        number = number[fine] - (number[fine] > empty)
        del words[empty]
    return words, number, ends


def repair_tokens_udf(matcher):
    """array<string> -> array<string> with every matched word replaced."""
    lookup = _Remembered(matcher)

    def repaired_part(tokens: pa.Array) -> pa.Array:
        words = tokens.flatten().dictionary_encode()
        known = words.dictionary.to_pylist()
        repaired = [m[0] if m else w for w, m in zip(known, lookup(known) if known else [])]
        values = pa.array(repaired, pa.string()).take(words.indices)
        lengths = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        mask = tokens.is_null() if tokens.null_count else None
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=mask)

    @arrow_udf(ArrayType(StringType()))
    def repair(tokens: pa.Array) -> pa.Array:
        parts = [repaired_part(part) for part in row_parts(tokens)]
        return pa.concat_arrays(parts) if parts else tokens

    return repair


def match_udf(matcher):
    """string -> struct(term, score), null without a match."""
    lookup = _Remembered(matcher)

    @arrow_udf(_MATCH)
    def match(words: pa.Array) -> pa.Array:
        found = lookup([w or "" for w in words.to_pylist()])
        rows = [None if m is None else {"term": m[0], "score": m[1]} for m in found]
        return pa.array(rows, pa.struct([("term", pa.string()), ("score", pa.float64())]))

    return match


def normal_tokens_udf(matcher, fillers: dict[str, str], variants: dict[str, str]):
    """string -> array<string>: the tokens with filler spellings, repairs and canonical forms, stutters dropped.

    All but the stutters depends on a token alone and is looked up once per task; a
    stutter is a token whose canonical form repeats the one before although the repaired words differ.
    ``matcher`` is None where nothing is repaired.
    """
    def forms(words: list[str]) -> list[tuple[str, str]]:
        filled = [fillers.get(w, w) for w in words]
        matches = matcher(filled) if matcher else [None] * len(words)
        repaired = [m[0] if m else w for w, m in zip(filled, matches)]
        return [(w, variants.get(w, w)) for w in repaired]

    lookup = _Remembered(forms)

    def part(texts: pa.Array) -> pa.Array:
        place, number, ends = split_words(texts)
        ids: dict[str, int] = {}
        found = lookup(place) if place else []
        source = np.array([ids.setdefault(w, len(ids)) for w, _ in found], np.int64)[number]
        target = np.array([ids.setdefault(c, len(ids)) for _, c in found], np.int64)[number]
        keep = np.ones(len(number), bool)
        keep[1:] = (target[1:] != target[:-1]) | (source[1:] == source[:-1])
        keep[ends[ends < len(number)]] = True
        offsets = np.concatenate([[0], np.cumsum(keep)])[ends].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(list(ids), pa.string()).take(pa.array(target[keep])))

    @arrow_udf(ArrayType(StringType()))
    def repair(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([part(rows) for rows in text_parts(texts)] or [part(texts)])

    return repair
