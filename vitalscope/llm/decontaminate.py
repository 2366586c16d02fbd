"""Benchmark decontamination by latent semantic retrieval.

1. TF-IDF: the words of the benchmark items are the vocabulary; their document
   frequencies are counted over all documents. The same pass keeps the counts of these words in every document.
2. A randomised SVD of the TF-IDF vectors of all items and all documents together gives
   the latent space. The rows of the matrix stay distributed: every task multiplies
   its rows by the current basis and back, and the products are summed in tasks by
   ranges of words. It starts from the items' own directions, so two rounds do.
   The rank is half of the number of items, at least 16 and at most 128.
3. Passages of every document, half overlapping windows as long as the items, are
   projected like the items, and those with a latent cosine of at least ``COSINE`` to
   an item that also hold half of ``SHARE`` of its words are candidates; every
   stretch that step 4 accepts has such a passage by its words. A passage without
   enough weight in the vocabulary is passed over before.
4. Candidates are checked on their words: the longest common subsequence with the
   item, in a stretch of the document little longer than the item, must hold
   ``SHARE`` of its words, and ``ANSWER`` of the item's answer words (those
   of an answer column, else its words that the fewest other items use) must
   occur there. So paraphrases with
   inserted, left out or exchanged words are found, and texts that share common
   words are not.
5. Items that stand word for word in a document are found by the hash of their first
   ``LEAST`` words (of all, if fewer) and compared whole, so no such copy depends on the space.

Whole texts are read, map-only; what travels is the item side. It is taken
``ITEMS`` items at a time, so that a large benchmark means more passes, never a
larger broadcast.

Defined cases: words are compared without case and outer punctuation; null and
empty texts match nothing; items below ``LEAST`` words are found word for word only,
items without a word never; repeated rows give repeated results; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Words, blocks, fresh, ranges, released, stored, window_hashes, with_id

ITEMS = 2048
RANKS, EXTRA, POWER = (16, 128), 16, 2  # least and largest rank
BLOCK = 1 << 19  # bytes of texts looked at together
MARKS = 18  # bits of a word's hash that tell most words of no item
DENSE = 1 << 21  # numbers of a dense piece of the matrix
PAIRS = 1 << 12  # passages and items whose words are compared at once
LEAST = 6
COSINE = 0.3
WORDS = 128  # rows of the sketch that travel together
TASK_ROWS, TASKS = 1 << 13, 512  # documents that a task multiplies at least; tasks at most, each sends a sketch
SHARE, ANSWER = 0.7, 0.6
ANSWERS = 5
SEED = 11
_OUTER = np.zeros(256, bool)
_OUTER[[ord(c) for c in ".,;:!?()[]{}'\"*_~-"]] = True


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the words of a block, without case and outer punctuation."""
    w = Words(texts, lower=True)
    doc = np.repeat(np.arange(len(texts)), np.diff(w.first))
    start, end = w.start.copy(), w.end.copy()
    for _ in range(3):
        start += (start < end) & _OUTER[w.data[np.minimum(start, max(len(w.data) - 1, 0))]] if len(w) else 0
        end -= (start < end) & _OUTER[w.data[np.maximum(end - 1, 0)]] if len(w) else 0
    fine = start < end
    w.start, w.end = start[fine], end[fine]
    return doc[fine], w.hashes()


class Items:
    """Some benchmark items: their words, vocabulary and weights."""

    def __init__(self, ids: list[int], texts: list[str], answers: list[str | None]) -> None:
        doc, hashed = tokens(pa.array(texts, pa.large_string()))
        cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
        keep = [i for i in range(len(texts)) if cuts[i + 1] > cuts[i]]
        self.ids = [ids[i] for i in keep]
        self.words = [hashed[cuts[i]:cuts[i + 1]] for i in keep]
        self.given = []
        for i in keep:
            own = tokens(pa.array([answers[i] or ""], pa.large_string()))[1]
            self.given.append(own[np.isin(own, hashed[cuts[i]:cuts[i + 1]])])
        self.vocabulary = np.unique(np.concatenate(self.words)) if keep else np.zeros(0, np.uint64)
        self.marked = np.zeros(1 << MARKS, bool)
        self.marked[self.vocabulary >> np.uint64(64 - MARKS)] = True

    def lookup(self, hashed: np.ndarray) -> np.ndarray:
        """The vocabulary number of each word, -1 for others."""
        out = np.full(len(hashed), -1, np.int64)
        maybe = np.flatnonzero(self.marked[hashed >> np.uint64(64 - MARKS)])  # the others need no search
        own = hashed[maybe]
        at = np.minimum(np.searchsorted(self.vocabulary, own), len(self.vocabulary) - 1)
        out[maybe] = np.where(self.vocabulary[at] == own, at, -1)
        return out

    def weigh(self, frequency: np.ndarray, documents: int) -> None:
        self.idf = np.log((documents + 1) / (frequency + 0.5))
        self.vectors = []
        for words in self.words:
            number, times = np.unique(self.lookup(words), return_counts=True)
            self.vectors.append((number, times * self.idf[number]))
        self.norm = np.array([np.sqrt((v * v).sum()) for _, v in self.vectors])
        # Without an answer column, the words that the fewest other items use.
        used = np.bincount(np.concatenate([n for n, _ in self.vectors]), minlength=len(self.vocabulary))
        self.answer = []
        for words, given in zip(self.words, self.given):
            unique = np.unique(given if len(given) else words)
            times = used[self.lookup(unique)]
            few = np.sort(times)[min(ANSWERS, len(times)) - 1]
            self.answer.append(set((unique if len(given) else unique[times <= few]).tolist()))
        self.length = np.array([len(w) for w in self.words])
        self.window = 2 ** np.ceil(np.log2(np.maximum(self.length, 8))).astype(int)
        self.searched = self.length >= LEAST

    def projected(self, space: np.ndarray) -> np.ndarray:
        """The items in the latent space, as unit vectors; one without a part in it is null."""
        return _unit(np.stack([v @ space[n] for n, v in self.vectors]))


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=-1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 1e-12)


def _frequencies(items: Items):
    """Documents per word, all documents under the number after the last word, and the words of every document that has any."""
    size = len(items.vocabulary)

    def run(batches):
        total = np.zeros(size + 1, np.int64)
        names = ["word", "n", "number", "times"]
        for batch in batches:
            for _, texts in blocks(batch.column(0), BLOCK):
                doc, hashed = tokens(texts)
                number = items.lookup(hashed)
                pairs, times = np.unique(doc[number >= 0] * size + number[number >= 0], return_counts=True)
                words = pairs % size
                total[:-1] += np.bincount(words, minlength=size)
                total[-1] += len(texts)
                first = np.append(np.flatnonzero(np.diff(pairs // size, prepend=-1)), len(pairs)).astype(np.int32)
                rows = len(first) - 1
                lists = [pa.ListArray.from_arrays(pa.array(first), pa.array(x.astype(np.int32))) for x in (words, times)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, -1)), pa.array(np.zeros(rows, np.int64)), *lists], names)
        seen = np.flatnonzero(total)
        none = pa.nulls(len(seen), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen]), none, none], names)
    return run


def _weighed(idf: np.ndarray):
    """Rows of counts as unit TF-IDF vectors."""
    def run(batches):
        for batch in batches:
            number, times = batch.column(0), batch.column(1).flatten().to_numpy(zero_copy_only=False)
            n = number.value_lengths().to_numpy(zero_copy_only=False)
            value = times * idf[number.flatten().to_numpy(zero_copy_only=False)]
            row = np.repeat(np.arange(len(n)), n)
            norm = np.sqrt(np.bincount(row, value * value, minlength=len(n)))[row]
            value = np.divide(value, norm, out=np.zeros_like(value), where=norm > 1e-12)
            ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([number, pa.ListArray.from_arrays(ends, pa.array(value))], ["number", "value"])
    return run


def _products(basis: np.ndarray):
    """The transposed matrix times (the matrix times ``basis``) over a task's rows, in ranges of words."""
    def run(batches):
        sums = np.zeros(basis.shape)
        rows = max(1, DENSE // len(basis))  # a few rows at a time are a dense matrix
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                number, value = (batch.column(i).slice(at, rows) for i in (0, 1))
                n = number.value_lengths().to_numpy(zero_copy_only=False)
                words, column = np.unique(number.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
                dense = np.zeros((len(n), len(words)), basis.dtype)
                dense[np.repeat(np.arange(len(n)), n), column] = value.flatten().to_numpy(zero_copy_only=False)
                sums[words] += dense.T @ (dense @ basis[words])
        starts = range(0, len(sums), WORDS)
        yield pa.RecordBatch.from_arrays([
            pa.array(list(starts), pa.int64()), pa.array([sums[i:i + WORDS].tobytes() for i in starts], pa.binary()),
        ], ["start", "part"])
    return run


def _summed(parts: pa.Table) -> pa.Table:
    """The sum of the binary parts of a range of words."""
    total = sum(np.frombuffer(p) for p in parts["part"].to_pylist())
    return pa.table({"start": parts["start"][:1], "part": pa.array([total.tobytes()], pa.binary())})


def start_basis(width: int, rank: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(SEED).normal(size=(width, min(rank + EXTRA, width))))[0]


def randomised_svd(rows: DataFrame, width: int, rank: int, basis: np.ndarray | None = None, power: int = POWER, kind: type = np.float64) -> np.ndarray:
    """The ``rank`` leading right singular vectors (width x rank) of a distributed sparse matrix.

    ``rows`` has number array<int or long>, value array<double>. Only the sketch, width
    times rank + EXTRA numbers, meets on the driver. ``basis`` is a better start than a random one;
    tasks multiply in numbers of ``kind`` and add up in doubles.
    """
    sketch = min(rank + EXTRA, width)
    basis = start_basis(width, rank) if basis is None else basis
    for _ in range(power + 1):
        parts = rows.mapInArrow(released(_products(basis.astype(kind))), "start long, part binary")
        # As many parts of WORDS rows as the matrix has partitions.
        summed = parts.groupBy("start").applyInArrow(_summed, "start long, part binary")
        product = np.zeros((width, sketch))
        for r in summed.collect():
            part = np.frombuffer(r["part"]).reshape(-1, sketch)
            product[r["start"]:r["start"] + len(part)] = part
        inner = basis.T @ product
        last, basis = basis, np.linalg.qr(product)[0]
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-values)[:rank]
    return last @ turn[:, order]


def latent_space(items: Items, rows: DataFrame) -> np.ndarray:
    """The leading directions of items and documents; the search for them starts from those of the items."""
    width = len(items.vocabulary)
    rank = min(max(RANKS), max(min(RANKS), len(items.ids) // 2), width)
    basis = start_basis(width, rank)
    product = np.zeros(basis.shape)
    for (number, value), norm in zip(items.vectors, items.norm):
        unit = value / max(norm, 1e-12)
        product[number] += np.outer(unit, unit @ basis[number])
    return randomised_svd(rows, width, rank, np.linalg.qr(product + 1e-9 * basis)[0], 1, np.float32)


def verbatim(items: Items):
    """A search for items word for word: (text, item, first word) of a block's words and their bounds."""
    size = np.minimum([len(w) for w in items.words], LEAST)
    tables = []
    for k in np.unique(size).tolist():
        own = np.flatnonzero(size == k)
        starts = np.array([window_hashes(items.words[i][:k], k)[0] for i in own], np.uint64)
        order = np.argsort(starts, kind="stable")
        tables.append((k, starts[order], own[order]))

    def search(hashed: np.ndarray, first: np.ndarray):
        for k, starts, own in tables:
            if len(hashed) < k:
                continue
            h = window_hashes(hashed, k)[:len(hashed) - k + 1]
            low = np.minimum(np.searchsorted(starts, h), len(starts) - 1)
            for at in np.flatnonzero(starts[low] == h).tolist():
                text = int(np.searchsorted(first, at, "right")) - 1
                for j in range(int(low[at]), len(starts)):
                    if starts[j] != h[at]:
                        break
                    words = items.words[own[j]]
                    if at + len(words) <= first[text + 1] and (hashed[at:at + len(words)] == words).all():
                        yield text, int(own[j]), int(at - first[text])
    return search


def common_subsequence(masks: dict[int, int], length: int, words: np.ndarray) -> int:
    """Length of the longest common subsequence, all places of the item at once as the bits of a number."""
    full = (1 << length) - 1
    state = full
    for word in words.tolist():
        same = masks.get(word)
        if same:
            both = state & same
            state = (state + both | state & ~same) & full
    return length - state.bit_count()


def _candidates(items: Items, space: np.ndarray):
    projected = items.projected(space).astype(np.float32)
    # Bits per word and item: has the item the word once, twice, more often? A passage's first, second and
    # later uses of a word count for items that use it as often.
    holds = np.zeros((3, len(items.vocabulary), (len(items.ids) + 7) // 8), np.uint8)
    for i, (number, value) in enumerate(items.vectors):
        times = np.round(value / items.idf[number])
        for uses in range(3):
            holds[uses, number[times > uses], i >> 3] |= 1 << (i & 7)
    exact = verbatim(items)
    weight = np.append(items.idf**2, 0.0)
    scaled = (items.idf[:, None] * space).astype(np.float32)
    sizes = sorted(set(items.window[items.searched].tolist()))
    masks = []
    for words in items.words:
        own: dict[int, int] = {}
        for i, word in enumerate(words.tolist()):
            own[word] = own.get(word, 0) | 1 << i
        masks.append(own)

    def judged(words: np.ndarray, start: int, stop: int, item: int) -> tuple[float, float, int] | None:
        """Shares of the item's and the answer's words near a passage, and where the stretch starts."""
        length = int(items.length[item])
        low, high = max(0, start - length), min(len(words), stop + length)
        if len(items.answer[item].intersection(words[low:high].tolist())) < ANSWER * len(items.answer[item]):
            return None  # rare words, so most false candidates end here
        own = np.fromiter((w in masks[item] for w in words[low:high].tolist()), bool, high - low)
        if own.sum() < SHARE * length:
            return None
        # The stretch of 1.25 times the item's length that holds most of its words.
        reach = min(int(1.25 * length) + 1, high - low)
        counts = np.concatenate([[0], np.cumsum(own)])
        dense = counts[reach:] - counts[:-reach]
        best = low + int(dense.argmax())
        stretch = words[best:best + reach]
        common = common_subsequence(masks[item], length, stretch) / length
        answer = len(items.answer[item] & set(stretch.tolist())) / max(1, len(items.answer[item]))
        return (common, answer, best) if common >= SHARE and answer >= ANSWER else None

    def sums(start: np.ndarray, stop: np.ndarray, step: int, known: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Weighted sums of the passages' words in the space; halves that neighbours share are summed once."""
        middle = np.minimum(start + step, stop)
        low, high = known[np.concatenate([start, middle])], known[np.concatenate([middle, stop])]
        some = high > low
        half, place, back = np.unique(low[some], return_index=True, return_inverse=True)
        n = (high - low)[some][place]
        longest = np.argsort(-n, kind="stable")
        half, left = half[longest], np.bincount(n)
        total = np.zeros((len(half) + 1, space.shape[1]), np.float32)
        alive = len(half)
        for k in range(len(left) - 1):  # the k-th word of all halves that have so many
            alive -= int(left[k])
            total[:alive] += scaled[numbers[half[:alive] + k]]
        at = np.empty(len(half), np.int64)
        at[longest] = np.arange(len(half))
        row = np.full(len(low), len(half))
        row[some] = at[back]
        return total[row[:len(start)]] + total[row[len(start):]]

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for at, texts in blocks(batch.column(1), BLOCK):
                doc, hashed = tokens(texts)
                first = np.searchsorted(doc, np.arange(len(texts) + 1))
                number = items.lookup(hashed)
                heavy = np.concatenate([[0.0], np.cumsum(weight[number])])
                known = np.concatenate([[0], np.cumsum(number >= 0)])
                numbers = number[number >= 0]
                found: dict[tuple[int, int], tuple] = {}
                for text, item, start in exact(hashed, first):
                    found.setdefault((text, item), (1.0, 1.0, 1.0, start))
                for size in sizes:
                    chosen = np.flatnonzero((items.window == size) & items.searched)
                    least = SHARE * (items.norm[chosen] ** 2).min() / 2
                    step = size // 2
                    per = np.maximum(1, -(-(np.diff(first) - step) // step)) * (np.diff(first) > 0)
                    owner = np.repeat(np.arange(len(texts)), per)
                    start = ranges(np.zeros(len(per), np.int64), per) * step + first[owner]
                    stop = np.minimum(start + size, first[owner + 1])
                    fine = heavy[stop] - heavy[start] >= least
                    owner, start, stop = owner[fine], start[fine], stop[fine]
                    target = projected[chosen].T
                    for low in range(0, len(start), 1024):
                        a, b = start[low:low + 1024], stop[low:low + 1024]
                        # Passages that are not passed over have words of the vocabulary.
                        n = known[b] - known[a]
                        places = numbers[ranges(known[a], n)]
                        cosine = _unit(sums(a, b, step, known, numbers)) @ target
                        passage, near = np.nonzero(cosine >= COSINE)
                        shared = np.zeros(len(passage), bool)
                        begin = np.cumsum(n) - n
                        key = np.repeat(np.arange(len(n)), n) * len(items.vocabulary) + places
                        order = np.argsort(key, kind="stable")
                        fresh_at = np.flatnonzero(np.diff(key[order], prepend=-1))
                        use = np.empty(len(key), np.int64)
                        use[order] = np.arange(len(key)) - np.repeat(fresh_at, np.diff(fresh_at, append=len(key)))
                        use = np.minimum(use, 2)
                        for cut in range(0, len(passage), PAIRS):
                            p, item = passage[cut:cut + PAIRS], chosen[near[cut:cut + PAIRS]]
                            place = ranges(begin[p], n[p])
                            item_of = np.repeat(item, n[p])
                            held = holds[use[place], places[place], item_of >> 3] >> (item_of & 7).astype(np.uint8) & 1
                            count = np.add.reduceat(held.astype(np.int64), np.cumsum(n[p]) - n[p])
                            shared[cut:cut + PAIRS] = count >= SHARE / 2 * items.length[item]
                        for i, j in zip(passage[shared].tolist(), near[shared].tolist()):
                            text, item = int(owner[low + i]), int(chosen[j])
                            if (text, item) in found:
                                continue
                            words = hashed[first[text]:first[text + 1]]
                            fact = judged(words, int(a[i] - first[text]), int(b[i] - first[text]), item)
                            if fact:
                                found[text, item] = (float(cosine[i, j]), *fact)
                rows = sorted(found.items())
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array([at + t for (t, _), _ in rows], pa.int64())), pa.array([items.ids[i] for (_, i), _ in rows], pa.int64()),
                    *(pa.array([f[k] for _, f in rows], pa.float64()) for k in range(3)), pa.array([f[3] for _, f in rows], pa.int64()),
                ], ["doc_id", "item_id", "cosine", "common_share", "answer_share", "first_word"])
    return run


FOUND = "doc_id long, item_id long, cosine double, common_share double, answer_share double, first_word long"


def matches(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", answer: str | None = None,
) -> DataFrame:
    """One row per document and benchmark item that it holds, exactly or as a paraphrase."""
    spark, rows = docs.sparkSession, with_id(docs, key, text)
    given = F.col(f"`{answer}`").cast("string") if answer else F.lit(None).cast("string")
    items = stored(benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"), given.alias("answer")).filter("text is not null"))
    parts = -(-items.count() // ITEMS)
    out = None
    for part in range(parts):  # each part of a large benchmark is a pass of its own
        of = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        taken = [tuple(r) for r in of.orderBy("item_id", "text").collect()]
        chosen = Items(*(list(c) for c in zip(*taken))) if taken else Items([], [], [])
        if not len(chosen.vocabulary):
            continue
        facts = stored(rows.select("text").mapInArrow(released(_frequencies(chosen)), "word long, n long, number array<int>, times array<int>"))
        frequency = np.zeros(len(chosen.vocabulary) + 1)
        for r in facts.filter("word >= 0").groupBy("word").agg(F.sum("n").alias("n")).collect():  # one number per word of the items
            frequency[r["word"]] = r["n"]
        chosen.weigh(frequency[:-1], int(frequency[-1]))
        used = facts.filter("word = -1").select("number", "times")
        own = spark.createDataFrame([(n.tolist(), np.round(v / chosen.idf[n]).astype(int).tolist()) for n, v in chosen.vectors], used.schema)
        tasks = min(TASKS, 1 + int(frequency[-1]) // TASK_ROWS)
        matrix = own.unionByName(used).coalesce(tasks).mapInArrow(released(_weighed(chosen.idf)), "number array<int>, value array<double>")
        found = rows.mapInArrow(released(_candidates(chosen, latent_space(chosen, matrix))), FOUND)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], FOUND)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without those that hold an item; all columns stay."""
    (name,) = fresh(docs, "__id")
    found = stored(matches(docs, benchmark, key, text).select(F.col("doc_id").alias(name)).distinct())
    return docs.join(found, F.col(f"`{key}`").cast("long").eqNullSafe(F.col(name)), "left_anti")
