"""Byte-level BPE encoding and decoding with a literal rank map.

Texts are cut into blocks of about ``BLOCK`` bytes. A block holds every text as
indexes and lists the distinct matches of the split pattern that are no tokens
themselves and that no earlier block of its task had, each as a string with one
character per token, at first one per byte. Spark higher-order functions then fold
the ranked merges over these words: the rank map is a literal in the plan, for every
token its pair of characters and its own, and a step puts the token wherever its pair stands.
At last a text's ids are gathered by its indexes from the words folded so far in
the task, and decoding concatenates the binary pieces of the ids.

One step per token is exact. Where merging the lowest pair (leftmost at a tie) makes
a token, it never merges across the token's ends before, so inside it does the same
as on the token alone: a token has one last pair, or is never made. Where each token
ranks above both of its pair, merges go through the ranks once, upwards. Only tokens
whose bytes occur in a word can be made in it; a walk of a trie over all words of a block finds them.
A rank file that breaks this order is folded by ``RankMap``, which looks up the lowest pair anew for every merge.

Nothing is shuffled or collected. Blocks stay in their task and in their order, as
rows of a few narrow steps, so a word is folded once per task. Both ends forget
the words at the first block that finds more than ``KNOWN`` of them, which bounds
memory whatever a task reads; a lost executor costs its own tasks only.

Ranks are the ids: a match that is a token is that token; otherwise the pair
whose bytes have the lowest rank is merged first.

Defined cases: null text is empty and has no ids; repeated rows give repeated
results; a text above the block size is a block of its own; a single match above
``LONG`` bytes is merged by a heap before the fold, which then leaves it alone;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .common import ranges, released, units, with_id

BLOCK = 1 << 20
KNOWN = 1 << 18
LONG = 400
NONE = 1 << 20  # above every id
FIRST = 0x100  # the character of token 0
# White space beyond ASCII: texts with it are split whole, not unit by unit.
_OTHER_SPACE = regex.compile(r"[\x1c-\x1f\x85\xa0  -     　]")


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ids."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * (1 + max(int(b) for _, b in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def pair_ids(tokens: list[bytes]) -> dict[tuple[int, int], int]:
    """The merged id of every pair of tokens whose bytes together are a token."""
    ids = {t: i for i, t in enumerate(tokens) if t}
    return {
        (ids[t[:k]], ids[t[k:]]): i
        for t, i in ids.items() for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids
    }


def char(token: int) -> str:
    """One character per token, none of them a surrogate."""
    code = token + FIRST
    return chr(code + 0x800 * (code >= 0xD800))


def codes(ids: np.ndarray) -> np.ndarray:
    """The code points of the tokens' characters."""
    code = ids.astype(np.uint32) + np.uint32(FIRST)
    return code + np.uint32(0x800) * (code >= 0xD800)


def ids_of(characters: np.ndarray) -> np.ndarray:
    return characters - np.uint32(0x800) * (characters > 0xDFFF) - np.uint32(FIRST)


class Merges:
    """The last pair of every token that merging by rank can make, and a trie of these tokens' bytes."""

    def __init__(self, tokens: list[bytes]) -> None:
        whole = {t: i for i, t in enumerate(tokens) if t}
        self.pairs: list[tuple[int, int] | None] = [None] * len(tokens)
        for token, i in whole.items():
            parts = [token[k:k + 1] for k in range(len(token))]
            while len(parts) > 2:
                rank, k = min((whole.get(parts[k] + parts[k + 1], NONE), k) for k in range(len(parts) - 1))
                if rank == NONE:
                    break
                parts[k:k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) == 2:
                self.pairs[i] = whole[parts[0]], whole[parts[1]]
        self.ordered = all(
            i > x for i, pair in enumerate(self.pairs) if pair for x in pair if len(tokens[x]) > 1
        )
        edges: dict[int, int] = {}
        ends = [-1]
        for i, token in enumerate(tokens):
            node = 0
            for byte in token if self.pairs[i] else b"":
                key = node << 8 | byte
                node = edges.get(key, 0)
                if not node:
                    node = edges[key] = len(ends)
                    ends.append(-1)
            if node:
                ends[node] = i
        self.edges, self.ends = np.array(list(edges), np.int64), np.array(ends, np.int32)

    def fold(self, words: Column, made: Column) -> Column:
        """Every word (a character per token) after the merges of ``made``, tokens by rank."""
        def read(values: list[str]) -> Column:
            return F.split(F.lit(",".join(values)), ",")

        pairs = [char(p[0]) + char(p[1]) if p else "" for p in self.pairs]
        tables = F.struct(read(pairs).alias("pairs"), read([char(i) for i in range(len(pairs))]).alias("tokens"))

        def folded(t: Column) -> Column:
            def step(word: Column, token: Column) -> Column:
                return F.replace(word, F.get(t["pairs"], token), F.get(t["tokens"], token))

            return F.zip_with(words, made, lambda word, own: F.aggregate(own, word, step))

        return _bound(tables, folded)


class Occurring:
    """Which tokens occur in the bytes of words: the trie as a hash table, walked from all bytes at once."""

    def __init__(self, edges: np.ndarray, ends: np.ndarray) -> None:
        self.ends = ends
        bits = (4 * len(edges) + 8).bit_length()
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys, self.next = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        left, at = np.arange(len(edges)), self._slot(edges)
        while len(left):
            put = np.zeros(len(left), bool)
            put[np.unique(at, return_index=True)[1]] = True
            put &= self.keys[at] < 0
            self.keys[at[put]], self.next[at[put]] = edges[left[put]], left[put] + 1
            left, at = left[~put], (at[~put] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The node after ``byte``; 0 where the trie has none."""
        key = node.astype(np.int64) << 8 | byte
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.next[at], 0)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.next[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def __call__(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct tokens of each word by rank: (tokens, tokens per word). The words are ``data`` cut by ``sizes``."""
        word, end = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.cumsum(sizes), sizes)
        at, found = np.arange(len(data)), [np.zeros(0, np.int64)]
        node = np.zeros(len(data), np.int32)
        while len(at):
            node = self._step(node, data[at])
            token = self.ends[node]
            made = np.flatnonzero(token >= 0)
            found.append(word[made] << 32 | token[made])
            fine = np.flatnonzero((node > 0) & (at + 1 < end))
            at, node, word, end = at[fine] + 1, node[fine], word[fine], end[fine]
        every = np.unique(np.concatenate(found))
        return (every & 0xFFFFFFFF).astype(np.int32), np.bincount(every >> 32, minlength=len(sizes))


class RankMap:
    """The pair table as folded literals: rows of one left token each, laid into one array.

    The entry of a pair is at offset[left] + right and names its left token, so
    rows may fill each other's gaps. A lookup reads one offset and one entry.
    """

    def __init__(self, pairs: dict[tuple[int, int], int]) -> None:
        rows: dict[int, list[int]] = {}
        for left, right in pairs:
            rows.setdefault(left, []).append(right)
        tokens = 1 + max((max(p) for p in pairs), default=0)
        taken = np.zeros(2 * len(pairs) + 4 * tokens, bool)
        self.offsets = np.full(tokens, -1, np.int64)
        first = tokens  # below lies the room of offsets that would be negative
        for left in sorted(rows, key=lambda x: (-len(rows[x]), x)):
            own = np.array(sorted(rows[left]))
            apart = own - own[0]
            at = first
            while True:  # the first place where all entries of the row are free
                while at + tokens + 4096 > len(taken):
                    taken = np.append(taken, np.zeros(len(taken), bool))
                free = at + np.flatnonzero(~taken[at:at + 4096])
                fits = free[~taken[free[:, None] + apart[1:]].any(1)] if len(apart) > 1 else free
                if len(fits):
                    break
                at += 4096
            place = int(fits[0])
            taken[place + apart] = True
            self.offsets[left] = place - own[0]
            if len(apart) == 1:
                first = place + 1
        entries = np.full(int(np.flatnonzero(taken)[-1]) + 1 if taken.any() else 1, -1, np.int64)
        for (left, right), merged in pairs.items():
            entries[self.offsets[left] + right] = left << 20 | merged
        self.entries = entries

    def literal(self) -> Column:
        """Both tables as one literal; the plan holds it once."""
        def read(values: np.ndarray, kind: str) -> Column:
            """Negative values are free places: empty in the text, null in the array."""
            return F.split(F.lit(",".join(str(v) if v >= 0 else "" for v in values.tolist())), ",").try_cast(kind)

        return F.struct(read(self.offsets, "array<int>").alias("offsets"), read(self.entries, "array<long>").alias("entries"))

    @staticmethod
    def merged(tables: Column, left: Column, right: Column) -> Column:
        """The merged id of two neighbours; null or a number from NONE on if they don't merge."""
        entry = F.get(tables["entries"], F.get(tables["offsets"], left) + right)
        return entry.bitwiseXOR(F.shiftleft(left.cast("long"), 20))

    def fold(self, words: Column, characters: list[str]) -> Column:
        """Every word (a character per token), left when no neighbours merge any more."""
        tables = F.struct(self.literal().alias("map"), F.split(F.lit(",".join(characters)), ",").alias("tokens"))

        def word(t: Column, text: Column) -> Column:
            code = F.transform(F.split(text, ""), F.ascii)
            ids = F.transform(code, lambda c: F.when(c > 0xDFFF, c - 0x800 - FIRST).otherwise(c - FIRST))
            return F.array_join(F.transform(_bound(ids, lambda x: self._fold(t["map"], x)), lambda i: F.get(t["tokens"], i)), "")

        return _bound(tables, lambda t: F.transform(words, lambda text: word(t, text)))

    def _fold(self, tables: Column, ids: Column) -> Column:
        """A number per token: the id it makes with its right neighbour, its place in the match and its own id.

        The smallest number is the next merge, leftmost at a tie. A first entry without a token spares the left end a case of its own.
        """
        own = F.lit((1 << 20) - 1)

        def gap(left: Column, right: Column) -> Column:
            return F.shiftleft(F.least(self.merged(tables, left, right), F.lit(NONE).cast("long")), 40)

        def kept(entry: Column) -> Column:
            return entry.bitwiseAND(F.lit((1 << 40) - 1))

        def token(entry: Column) -> Column:
            return entry.bitwiseAND(own).cast("int")

        def step(state: Column, _: Column) -> Column:
            def merge(best: Column) -> Column:
                new = F.shiftright(best, 40).cast("int")

                def at(i: Column) -> Column:
                    before = F.get(state, i - 2)
                    both = F.array(
                        gap(token(before), new) + kept(before),
                        gap(new, token(F.get(state, i + 1))) + kept(best) - best.bitwiseAND(own) + new,
                    )
                    return F.concat(F.slice(state, 1, i - 2), both, F.slice(state, i + 2, F.size(state)))

                return F.when(best < NONE << 40, _bound(F.array_position(state, best).cast("int"), at)).otherwise(state)

            return _bound(F.array_min(state), merge)

        few = F.size(ids) - 1
        entries = F.transform(ids, lambda x, i: gap(x, F.get(ids, i + 1)) + F.shiftleft(i.cast("long"), 20) + x)
        start = F.concat(F.array(F.lit((NONE << 40) + NONE - 1).cast("long")), entries)
        folded = F.aggregate(
            F.sequence(F.lit(1), few), start, step, lambda s: F.transform(F.slice(s, 2, F.size(s)), token)
        )
        return F.when(few < 1, ids).otherwise(folded)


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _heap_merge(ids: list[int], tokens: list[bytes], whole: dict[bytes, int]) -> list[int]:
    """The same merges for one very long match, in n log n."""
    def pair(a: int, b: int) -> int | None:
        return whole.get(tokens[a] + tokens[b])

    after, before, alive = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), [True] * len(ids)
    heap = [(m, i) for i in range(len(ids) - 1) if (m := pair(ids[i], ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        m, i = heapq.heappop(heap)
        j = after[i] if alive[i] else len(ids)
        if j >= len(ids) or pair(ids[i], ids[j]) != m:
            continue
        ids[i], alive[j], after[i] = m, False, after[j]
        if after[i] < len(ids):
            before[after[i]] = i
            if (n := pair(m, ids[after[i]])) is not None:
                heapq.heappush(heap, (n, i))
        if before[i] >= 0 and (n := pair(ids[before[i]], m)) is not None:
            heapq.heappush(heap, (n, before[i]))
    return [x for x, a in zip(ids, alive) if a]


def _written(words: list[np.ndarray]) -> pa.Array:
    """Words of token ids as strings with a character per token."""
    flat = codes(np.concatenate([np.zeros(0, np.int64), *words]))
    wide = 1 + (flat >= 0x80) + (flat >= 0x800) + (flat >= 0x10000)
    ends = np.cumsum(np.array([0, *map(len, words)]))
    offsets = np.concatenate([[0], np.cumsum(wide)])[ends].astype(np.int32)
    data = flat.astype("<u4").tobytes().decode("utf-32-le").encode()
    return pa.Array.from_buffers(pa.string(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _prepared(tokens: list[bytes], pattern: str, edges: np.ndarray, ends: np.ndarray):
    def block(ids: list, texts: list[str], whole: dict, single: np.ndarray, split, known: dict, seen: dict, occurring) -> pa.RecordBatch:
        odd = {i for i, t in enumerate(texts) if _OTHER_SPACE.search(t)}
        pieces, counts = units(pa.array(["" if i in odd else t for i, t in enumerate(texts)], pa.large_string()))
        coded = pieces.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        distinct = coded.dictionary.to_pylist()
        if odd:  # such a text is one unit
            chunks, at = [], 0
            for i, n in enumerate(counts):
                chunks.append(np.array([len(distinct)], np.int32) if i in odd else index[at:at + n])
                at += n
                if i in odd:
                    distinct.append(texts[i])
            index, counts = np.concatenate(chunks), np.array([len(c) for c in chunks])
        if len(known) > KNOWN or len(seen) > 2 * KNOWN:
            known.clear()
            seen.clear()
        restart, words, parts, sizes = not known, [], [], []
        for unit in distinct:
            numbers = seen.get(unit)  # of all matches of a unit that came before
            if numbers is None:
                numbers = []
                matches = split.findall(unit)
                for match in matches:
                    raw = match.encode()
                    number = whole.get(raw)
                    if number is None:
                        number = known.get(match)
                        if number is None:
                            number = known[match] = len(tokens) + len(known)
                            words.append(raw)
                    numbers.append(number)
                if len(unit) <= LONG:
                    seen[unit] = numbers[0] if len(numbers) == 1 else numbers
            elif numbers.__class__ is int:
                parts.append(numbers)
                sizes.append(1)
                continue
            parts += numbers
            sizes.append(len(numbers))
        short = [w if len(w) <= LONG else b"" for w in words]
        made, each = occurring(np.frombuffer(b"".join(short), np.uint8), np.array([len(w) for w in short], np.int64))
        begins = [single[np.frombuffer(w, np.uint8)] if len(w) <= LONG else np.array(_heap_merge(single[list(w)].tolist(), tokens, whole)) for w in words]
        values = {
            "ids": pa.array([ids], pa.list_(pa.int64())),
            "counts": pa.array([np.asarray(counts, np.int64).tobytes()], pa.binary()),
            "index": pa.array([index.tobytes()], pa.binary()),
            "sizes": pa.array([np.array(sizes, np.int32).tobytes()], pa.binary()),
            "parts": pa.array([np.array(parts, np.int32).tobytes()], pa.binary()),
            "words": _one(_written(begins)),
            "made": _one(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(each)]).astype(np.int32), pa.array(made))),
            "restart": pa.array([restart]),
        }
        return pa.RecordBatch.from_pydict(values)

    def run(batches):
        whole = {t: i for i, t in enumerate(tokens) if t}
        single = np.array([whole[bytes([b])] for b in range(256)], np.int64)
        tables = whole, single, regex.compile(pattern), {}, {}, Occurring(edges, ends)
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = t or ""
                if texts and size + len(t) > BLOCK:
                    yield block(ids, texts, *tables)
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        if texts:
            yield block(ids, texts, *tables)
    return run


def _one(rows: pa.Array) -> pa.Array:
    """All rows as the list of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)


def _read(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The token ids of written words: (ids, ids per word)."""
    kind = np.int64 if pa.types.is_large_string(words.type) else np.int32
    offsets = np.frombuffer(words.buffers()[1], kind)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return ids_of(np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)), np.diff(starts[offsets - offsets[0]])


def _gather(values: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists (values cut by sizes) picked by ``index``: (values, sizes)."""
    begins = np.cumsum(sizes) - sizes
    return values[ranges(begins[index], sizes[index])], sizes[index]


def _gathered(tokens: list[bytes], full: bool):
    def run(batches):
        pieces = pa.array(tokens, pa.large_binary())
        piece_data = np.frombuffer(pieces.buffers()[2], np.uint8)
        piece_sizes = np.array([len(t) for t in tokens], np.int64)
        own_tokens = np.arange(len(tokens), dtype=np.uint32), np.ones(len(tokens), np.int64)  # a token is its own id
        values, word_sizes = own_tokens
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column(0)[row].as_py()
                counts, index, sizes, parts = (
                    np.frombuffer(batch.column(i)[row].as_py(), t) for i, t in ((1, np.int64), (2, np.int32), (3, np.int32), (4, np.int32))
                )
                if batch.column(6)[row].as_py():
                    values, word_sizes = own_tokens
                words = batch.column(5)[row].values
                if len(words):
                    more, each = _read(words)
                    values, word_sizes = np.concatenate([values, more]), np.concatenate([word_sizes, each])
                at, picked = np.cumsum(sizes) - sizes, sizes.astype(np.int64)
                flat, each = _gather(values, word_sizes, parts)  # ids of all units in a row
                reach = np.concatenate([[0], np.cumsum(each)])
                unit_at, unit_sizes = reach[at], reach[at + picked] - reach[at]
                place, ends = 0, np.cumsum(counts)
                for first in range(0, len(ids), 512):  # a few texts at a time keep the arrays small
                    last = min(first + 512, len(ids))
                    own = index[place:ends[last - 1]]
                    place = ends[last - 1]
                    got = flat[ranges(unit_at[own], unit_sizes[own])]
                    data, _ = _gather(piece_data, piece_sizes, got)
                    cuts = np.concatenate([[0], np.cumsum(unit_sizes[own])])[np.concatenate([[0], np.cumsum(counts[first:last])])]
                    byte_cuts = np.concatenate([[0], np.cumsum(piece_sizes[got])])[cuts]
                    out = []
                    for k in range(last - first):
                        tokens_of = got[cuts[k]:cuts[k + 1]].astype("<u4")
                        raw = data[byte_cuts[k]:byte_cuts[k + 1]].tobytes()
                        out.append((ids[first + k], tokens_of, raw))
                    columns = [pa.array([o[0] for o in out], pa.int64())]
                    if full:
                        columns += [pa.array([o[1] for o in out], pa.list_(pa.int32())), pa.array([o[2] for o in out], pa.binary())]
                        names = ["doc_id", "ids", "decoded"]
                    else:
                        columns += [
                            pa.array([len(o[1]) for o in out], pa.int64()),
                            pa.array([hashlib.sha256(o[1].tobytes()).hexdigest() for o in out], pa.string()),
                            pa.array([hashlib.sha256(o[2]).hexdigest() for o in out], pa.string()),
                        ]
                        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                    yield pa.RecordBatch.from_arrays(columns, names)
    return run


def encode(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """Token ids of every text and the bytes they decode to.

    ``digests``: doc_id, n_tokens and SHA-256 of the ids (little-endian, 32 bits)
    and of the decoded bytes, in place of ids (array<int>) and decoded (binary).
    """
    tokens = load_ranks(ranks)
    merges = Merges(tokens)
    blocks = with_id(docs, key, text).mapInArrow(
        released(_prepared(tokens, pattern, merges.edges, merges.ends)),
        "ids array<long>, counts binary, index binary, sizes binary, parts binary, words array<string>, made array<array<int>>, restart boolean",
    )
    if merges.ordered:
        words = merges.fold(F.col("words"), F.col("made"))
    else:
        words = RankMap(pair_ids(tokens)).fold(F.col("words"), [char(i) for i in range(len(tokens))])
    folded = blocks.withColumn("words", words).drop("made")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>, decoded binary"
    return folded.mapInArrow(released(_gathered(tokens, not digests)), schema)
