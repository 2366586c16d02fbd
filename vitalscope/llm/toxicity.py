"""Toxicity scores from a learned lexicon that also catches misspelled terms.

1. Lexicon: on labelled documents, terms and word beginnings (stems) whose share of
   toxic documents is high with confidence go into a trie.
2. Matching: a word is a hit if it begins with a stem, is a term, or a
   Levenshtein automaton of the word, run along the trie, reaches a term within
   one edit (two from nine letters on). Each distinct word of a block is matched once.
3. Context: every hit is judged in a window of words around it. Hits inside
   quotation marks are counted apart from plain ones, and hits that stand close
   together add up to the window's score.
4. A logistic regression on these few numbers gives the score.

The lexicon and the regression are fitted on at most ``TRAIN`` labelled rows, taken
by a hash of doc_id; every row of the input is scored, whole texts, map-only.

Defined cases: null and empty texts have no hits and score like any clean short
text; labels that are null count as absent, and a doc_id with several labels
takes the largest; without labels of both kinds every score is 0; repeated rows
score alike; a null doc_id is never a training row and not held out; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import LARGE_BLOCK, Vocabulary, blocks, stored, with_id

TRAIN = 20_000
STEM_LENGTHS = (3, 4, 5, 6, 7)
SHARE = 0.4  # least lower bound of a term's toxic share
SURE = 2.6  # standard errors of the lower bound of a term's toxic share
WINDOW = 6
EDGE = ".,;:!?()[]{}'*_~-\"“”„«»‹›"
QUOTES = "\"“”„«»"
FEATURES = 9


def clean(word: str) -> str:
    return word.strip(EDGE).lower()


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def training_rows(labels: DataFrame, name: str, modulus: int, left_out: int, limit: int | None = TRAIN) -> DataFrame:
    """doc_id and label of the rows outside the held-out fold, at most ``limit`` of them."""
    rows = labels.select(F.col("doc_id").cast("long"), F.col(name).cast("int").alias("label")).filter(
        F.col("label").isNotNull() & (remainder(F.col("doc_id"), modulus) != left_out)
    )
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    return rows if limit is None else rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


class Lexicon:
    """Terms in a trie, stems, and the walk of a word's Levenshtein automaton along the trie."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float]) -> None:
        self.terms, self.stems = terms, stems
        self.lengths = sorted({len(s) for s in stems})
        self.trie: dict = {}
        # Of edits + 1 pieces of a term one stays whole: the first, the last or the middle
        # one. A piece leads to the lengths of the words that may come from its terms.
        self.heads, self.tails, self.middles = {}, {}, {}
        for term in terms:
            node = self.trie
            for letter in term:
                node = node.setdefault(letter, {})
            node[""] = term
            edits = self.edits(len(term))
            if edits:
                cut = len(term) // (edits + 1)
                sizes = range(len(term) - edits, len(term) + edits + 1)
                self.heads.setdefault(cut, {}).setdefault(term[:cut], set()).update(sizes)
                tail = term[-cut:] if edits == 2 else term[cut:]
                self.tails.setdefault(len(tail), {}).setdefault(tail, set()).update(sizes)
                if edits == 2:
                    self.middles.setdefault(term[cut:-cut], set()).update(sizes)

    @staticmethod
    def edits(length: int) -> int:
        return 0 if length < 5 else 1 if length < 9 else 2

    def match(self, word: str) -> tuple[int, float]:
        """(kind, weight): 0 no hit, 1 term, 2 stem, 3 misspelled term."""
        stem = next((word[:n] for n in self.lengths if word[:n] in self.stems), None)
        if word in self.terms and stem in (None, word):
            return 1, self.terms[word]
        if stem is not None:
            return 2, self.stems[stem]
        size = len(word)
        if (
            any(size in d.get(word[:n], ()) for n, d in self.heads.items())
            or any(size in d.get(word[-n:], ()) for n, d in self.tails.items())
            or any(size in sizes and m in word for m, sizes in self.middles.items())
        ):
            term = self.nearest(word)
            if term is not None:
                return 3, self.terms[term]
        return 0, 0.0

    def nearest(self, word: str) -> str | None:
        """The closest term within its edits, the first in order at a tie.

        The automaton's states are the places in the word, as the bits of a number
        for each count of edits; a branch of the trie is left when none is alive.
        """
        letters: dict[str, int] = {}
        for i, letter in enumerate(word):
            letters[letter] = letters.get(letter, 0) | 2 << i
        full, goal = (2 << len(word)) - 1, 1 << len(word)
        best: tuple[int, str] | None = None
        stack = [(self.trie, 1, 3 & full, 7 & full)]
        while stack:
            node, none, one, two = stack.pop()
            for letter, child in node.items():
                if letter == "":
                    spent = 0 if none & goal else 1 if one & goal else 2 if two & goal else 3
                    if spent <= self.edits(len(child)) and (best is None or (spent, child) < best):
                        best = (spent, child)
                    continue
                same = letters.get(letter, 0)
                to_none = none << 1 & same
                to_one = (one << 1 & same | none | none << 1 | to_none << 1) & full
                to_two = (two << 1 & same | one | one << 1 | to_one << 1) & full
                if to_two:
                    stack.append((child, to_none, to_one, to_two))
        return best[1] if best else None


def _counts(batches):
    """(term, stem, toxic, clean): documents of each class with a term or a stem."""
    for batch in batches:
        labels = np.array(batch.column(1).to_pylist(), np.int64)
        for at, texts in blocks(batch.column(0), LARGE_BLOCK):
            words = Vocabulary(texts)
            names = [clean(w) for w in words.words]
            toxic = labels[at:at + len(texts)]
            for length in (None, *STEM_LENGTHS):
                known: dict[str, int] = {}
                cut = [n if length is None else n[:length] if len(n) > length else "" for n in names]
                place = np.array([known.setdefault(c, len(known)) for c in cut], np.int64)
                pairs = np.unique(words.doc * (len(known) + 1) + place[words.unit]) if len(words.doc) else np.zeros(0, np.int64)
                term, doc = pairs % (len(known) + 1), pairs // (len(known) + 1)
                bad = np.bincount(term[toxic[doc] > 0], minlength=len(known))
                good = np.bincount(term[toxic[doc] == 0], minlength=len(known))
                keep = np.flatnonzero(bad)
                terms = list(known)
                yield pa.RecordBatch.from_arrays([
                    pa.array([terms[i] for i in keep], pa.string()), pa.array([length is not None] * len(keep), pa.bool_()),
                    pa.array(bad[keep], pa.int64()), pa.array(good[keep], pa.int64()),
                ], ["term", "stem", "toxic", "clean"])


def _places(words: Vocabulary, wanted: dict, length: int | None) -> np.ndarray:
    """For every word of a block, the number of the wanted term or stem that it is, or -1."""
    stem = length is not None
    names = (clean(w) for w in words.words)
    cut = [(n if not stem else n[:length] if len(n) > length else "") for n in names]
    return np.array([wanted.get((c, stem), -1) for c in cut], np.int64)[words.unit]


def _contexts(wanted: dict):
    """(place, context): the words around each wanted term or stem, once each for a block."""
    def run(batches):
        for batch in batches:
            for _, texts in blocks(batch.column(0), LARGE_BLOCK):
                words = Vocabulary(texts)
                if not len(words.unit):
                    continue
                hashed = np.array([hash_word(w) for w in words.words], np.int64)[words.unit]
                near = hashed.astype(np.uint64)
                around = near * np.uint64(3) + np.roll(near, 1) * np.uint64(5) + np.roll(near, -1) * np.uint64(7)
                before = around.view(np.int64)
                for length in (None, *STEM_LENGTHS):
                    place = _places(words, wanted, length)
                    pairs = np.unique(np.stack([place[place >= 0], before[place >= 0]]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["place", "context"])
    return run


def hash_word(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little", signed=True)


def _clean_counts(wanted: dict):
    """(place, clean): clean documents with one of the ``wanted`` terms or stems."""
    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for _, texts in blocks(batch.column(0), LARGE_BLOCK):
                words = Vocabulary(texts)
                for length in (None, *STEM_LENGTHS):
                    if len(words.doc):
                        term = _places(words, wanted, length)
                        pairs = np.unique(words.doc[term >= 0] * (len(wanted) + 1) + term[term >= 0])
                        total.update((pairs % (len(wanted) + 1)).tolist())
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["place", "clean"])
    return run


def lower_bound(hits: float, n: float) -> float:
    """Wilson's lower bound of a share at SURE standard errors."""
    z = SURE * SURE
    share = hits / n
    return (share + z / (2 * n) - SURE * np.sqrt(share * (1 - share) / n + z / (4 * n * n))) / (1 + z / n)


def learn_lexicon(train: DataFrame) -> Lexicon:
    """Terms and stems from labelled texts (columns text, label).

    Support in toxic documents is counted in different contexts (a hash of the
    word and its neighbours), so that the rare words of one text with many copies don't count.
    Counts are summed in tasks before a shuffle. A term needs several toxic
    documents, so what reaches the driver is bounded by the training rows.
    """
    toxic, harmless = train.filter("label > 0").select("text", "label"), train.filter("label = 0").select("text")
    least = int(np.ceil(SURE * SURE))
    counted = toxic.mapInArrow(_counts, "term string, stem boolean, toxic long, clean long").groupBy("term", "stem").agg(F.sum("toxic").alias("n"))
    counted = counted.filter((F.col("n") >= least) & (F.length("term") > 2)).orderBy("term", "stem").collect()
    frequent = [(r["term"], r["stem"]) for r in counted]
    wanted = {t: i for i, t in enumerate(frequent)}
    contexts = toxic.select("text").mapInArrow(_contexts(wanted), "place long, context long").distinct().groupBy("place").count()
    support = dict(contexts.filter(F.col("count") >= least).collect())
    found = [(*frequent[i], min(n, counted[i]["n"])) for i, n in sorted(support.items())]
    wanted = {(t, s): i for i, (t, s, _) in enumerate(found)}
    counts = harmless.mapInArrow(_clean_counts(wanted), "place long, clean long")
    harmless = dict(counts.groupBy("place").agg(F.sum("clean")).collect())
    terms, stems = {}, {}
    alone = {}  # toxic documents of the commonest term with a beginning
    for term, stem, n in found:
        if not stem:
            for k in STEM_LENGTHS:
                alone[term[:k]] = max(alone.get(term[:k], 0), n)
    for i, (term, stem, n) in enumerate(found):
        total = n + harmless.get(i, 0)
        if lower_bound(n, total) > SHARE and not (stem and alone.get(term, 0) > 0.8 * n):
            (stems if stem else terms)[term] = float(np.log((n + 0.5) / (total - n + 0.5)))
    # A stem that a shorter one covers adds nothing. A term that it covers does: its misspellings.
    short = {t: w for t, w in stems.items() if not any(t[:k] in stems for k in range(1, len(t)))}
    return Lexicon(terms, short)


def features(words: Vocabulary, lexicon: Lexicon, count: int) -> np.ndarray:
    """FEATURES numbers for each text of a block."""
    matched = [lexicon.match(clean(w)) for w in words.words]
    kind, weight = np.array([m[0] for m in matched], np.int64), np.array([m[1] for m in matched])
    quotes = np.array([sum(map(w.count, QUOTES)) for w in words.words], np.int64)
    opens = np.array([w[:1] in QUOTES and w[:1] != "" for w in words.words], bool)
    out = np.zeros((count, FEATURES))
    size = np.diff(words.first)
    if len(words.unit):
        before = np.cumsum(quotes[words.unit]) - quotes[words.unit]
        base = np.repeat(before[words.first[:-1][size > 0]], size[size > 0])
        inside = (before - base + opens[words.unit]) % 2 == 1
        k = kind[words.unit]
        at = np.flatnonzero(k)
        doc, w, quoted = words.doc[at], weight[words.unit[at]], inside[at]
        for column, chosen in enumerate(((k[at] == 1) & ~quoted, (k[at] == 2) & ~quoted, (k[at] == 3) & ~quoted, quoted)):
            out[:, column] = np.log1p(np.bincount(doc[chosen], np.maximum(w[chosen], 0.1), minlength=count))
        # Window score: the weights of the plain hits within WINDOW words, most for a text.
        plain = np.where(quoted, -0.5 * w, w)
        reach = np.concatenate([[0.0], np.cumsum(plain)])
        low = np.searchsorted(at, np.maximum(at - WINDOW, words.first[doc]))
        high = np.searchsorted(at, np.minimum(at + WINDOW + 1, words.first[doc + 1]))
        np.maximum.at(out[:, 4], doc, reach[high] - reach[low])
        np.maximum.at(out[:, 5], doc, w * (k[at] < 3))
        out[:, 6] = np.bincount(doc, minlength=count) > 0
        out[:, 7] = 100 * np.bincount(doc, minlength=count) / np.maximum(size, 1)
    out[:, 8] = np.log1p(size)
    return out


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights with the constant last, means, scales) by Newton steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, ridge = np.zeros(z.shape[1]), penalty * np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


def _measured(lexicon: Lexicon):
    def run(batches):
        for batch in batches:
            for at, texts in blocks(batch.column(1), LARGE_BLOCK):
                f = features(Vocabulary(texts), lexicon, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(list(f), pa.list_(pa.float64()))], ["doc_id", "f"]
                )
    return run


def _scored(lexicon: Lexicon, model):
    def run(batches):
        w, mean, scale = model
        for batch in batches:
            for at, texts in blocks(batch.column(1), LARGE_BLOCK):
                f = features(Vocabulary(texts), lexicon, len(texts))
                score = 1 / (1 + np.exp(-np.clip((f - mean) / scale @ w[:-1] + w[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(score, pa.float64())], ["doc_id", "score"])
    return run


def score(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    modulus: int = 5, left_out: int = 0,
) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    rows = with_id(docs, key, text)
    train = stored(rows.join(F.broadcast(training_rows(labels, label, modulus, left_out)), "doc_id"))
    kinds = {r[0] for r in train.select("label").distinct().limit(3).collect()}
    if len({k > 0 for k in kinds}) < 2:
        scored = rows.select("doc_id", F.lit(0.0).alias("score"))
    else:
        lexicon = learn_lexicon(train)
        measured = train.select("doc_id", "text").mapInArrow(_measured(lexicon), "doc_id long, f array<double>")
        given = train.select("doc_id", "label").distinct()
        table = measured.join(F.broadcast(given), "doc_id").select("f", "label").collect()  # at most TRAIN short rows
        model = logistic(np.array([r["f"] for r in table]), np.array([r["label"] > 0 for r in table], float))
        scored = rows.mapInArrow(_scored(lexicon, model), "doc_id long, score double")
    return scored.select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), modulus) == left_out, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
