"""Quality scores by a generalised additive model with pairwise interactions.

Each text becomes ``len(FEATURES)`` numbers about its letters, words and
repetitions. Shallow trees are boosted in cycles over the features, a small step
each, and end up as one lookup table per feature; then the pairs of features with
the largest gain on the residual get a table each in the same way. A score is the
sum of the tables' entries at a text's bins.

The model is fitted on every labelled row. Their features are dealt by a hash of doc_id
into parts of about ``PART`` rows; each part is fitted in a task of its own, on bins that
all parts share, and the tables are averaged by rows, which gives one additive model again. The pairs
are those with the largest gain over all parts, boosted on the residual of the averaged
tables. Up to ``PART`` rows are one part. Every row of the input is measured and scored
over its whole text, map-only.

Defined cases: null and empty texts have all features 0; labels that are null
count as absent, and a doc_id with several labels takes the largest; without
labels of both kinds every score is the share of label 1, or 0; repeated rows
score alike; a null doc_id is never a training row and not held out; an empty
table gives no rows; other columns are ignored. Rows of one doc_id are in one part.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vitalscope.session import is_small

from .common import Words, blocks, released, stored, window_hashes, with_id
from .toxicity import remainder, training_rows

PART = 20_000
# Labels are sent to the texts below this number, beyond it features are shuffled.
SENT = 100_000
# Texts are measured in blocks of this many bytes: a block takes about sixty times its size.
BLOCK = 1 << 19
BINS, PAIR_BINS, PAIRS = 48, 12, 8
ROUNDS, RATE, RIDGE = 160, 0.12, 4.0

# Classes of bytes: lower, upper, digit, space, line end, ! , |, stops, symbols, the rest.
_CLASS = np.full(256, 9, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, 9]], _CLASS[[10, 13, 11, 12]], _CLASS[33], _CLASS[124] = 3, 4, 5, 6
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 7
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = 8
_CLASSES = 10
FEATURES = (
    "lower", "upper", "digit", "space", "lines", "exclaim", "bars", "stops", "symbols", "other",
    "words", "word_length", "length_spread", "short_words", "long_words", "capital_starts", "shouted",
    "ends_stop", "ends_symbol", "distinct", "repeats", "distinct_pairs", "distinct_fours", "commonest",
)


def measure(texts: pa.Array) -> np.ndarray:
    """The features of a block of texts, one row each."""
    w = Words(texts)
    n = len(texts)
    size = np.diff(w.bounds)
    kind = _CLASS[w.data]
    counts = np.bincount(np.repeat(np.arange(n) * _CLASSES, size) + kind, minlength=n * _CLASSES).reshape(n, _CLASSES)
    out = np.zeros((n, len(FEATURES)))
    out[:, :_CLASSES] = counts / np.maximum(size, 1)[:, None]
    words = np.diff(w.first)
    if not len(w):
        return out
    doc, length = np.repeat(np.arange(n), words), (w.end - w.start).astype(float)
    per = 1 / np.maximum(words, 1)

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(doc, flags.astype(float), n) * per

    first, last = kind[w.start], kind[w.end - 1]
    uppers = np.concatenate([[0], np.cumsum(kind == 1)])
    mean = share(length)
    hashed = w.hashes()
    same = np.zeros(len(w), bool)
    same[1:] = (hashed[1:] == hashed[:-1]) & (doc[1:] == doc[:-1])
    columns = [
        np.log1p(words), mean, np.sqrt(np.maximum(share(length**2) - mean**2, 0)), share(length <= 2), share(length > 14),
        share(first == 1), share((uppers[w.end] - uppers[w.start]) > 0.5 * length), share(last == 7), share((last == 8) | (last == 5)),
    ]
    order = np.lexsort((hashed, doc))
    key, owner = hashed[order], doc[order]
    new = np.ones(len(w), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(new)
    commonest = np.zeros(n)
    np.maximum.at(commonest, owner[starts], np.diff(np.append(starts, len(w))))
    columns += [np.bincount(owner[starts], minlength=n) * per, share(same)]
    for k in (2, 4):
        fits = np.arange(len(w)) + k <= w.first[1:][doc]
        grams, own = window_hashes(hashed, k)[fits], doc[fits]
        order = np.lexsort((grams, own))
        g, o = grams[order], own[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (o[1:] != o[:-1])
        columns.append(np.bincount(o[new], minlength=n) / np.maximum(np.bincount(own, minlength=n), 1))
    out[:, _CLASSES:] = np.stack([*columns, commonest * per], axis=1)
    return out


def _sigmoid(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, splits: int = 2) -> np.ndarray:
    """Leaf values per bin of a tree with ``splits`` best splits along one feature."""
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    cuts = [0, len(g)]
    for _ in range(splits):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            inner = np.arange(a + 1, b)
            if not len(inner):
                continue
            gain = (
                (G[inner] - G[a]) ** 2 / (H[inner] - H[a] + RIDGE) + (G[b] - G[inner]) ** 2 / (H[b] - H[inner] + RIDGE)
                - (G[b] - G[a]) ** 2 / (H[b] - H[a] + RIDGE)
            )
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], int(inner[k]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + RIDGE)
    return out


def _corner(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, leaf values per cell) of the best tree with one split on each of two features."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    parts = []
    for S in (G, H):
        a = S[:-1, :-1]
        row, column, all_ = S[:-1, -1:], S[-1:, :-1], S[-1, -1]
        parts.append((a, row - a, column - a, all_ - row - column + a))
    gain = sum(x**2 / (y + RIDGE) for x, y in zip(*parts)) - G[-1, -1] ** 2 / (H[-1, -1] + RIDGE)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.empty(g.shape)
    for x, y, rows, columns in zip(
        *parts, (slice(0, i + 1), slice(0, i + 1), slice(i + 1, None), slice(i + 1, None)),
        (slice(0, j + 1), slice(j + 1, None), slice(0, j + 1), slice(j + 1, None)),
    ):
        out[rows, columns] = x[i, j] / (y[i, j] + RIDGE)
    return float(gain[i, j]), out


GRID, COARSE = np.linspace(0, 1, BINS + 1)[1:-1], np.linspace(0, 1, PAIR_BINS + 1)[1:-1]


class Part:
    """Some labelled rows, and what a fit asks of them."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        order = np.lexsort((*x.T, y))  # the fit does not depend on the order of the rows
        self.x, self.y = x[order], y[order].astype(float)

    def quantiles(self) -> list[np.ndarray]:
        """Quantiles of every feature for its bins and for those of pairs, and the share of label 1."""
        both = np.concatenate([GRID, COARSE])
        return [np.quantile(self.x, both, axis=0), np.array([self.y.mean()])]

    def singles(self, model: Additive) -> list[np.ndarray]:
        """Tables of the single features, one after the other, and the gain of every pair on their residual."""
        tables = [np.zeros(len(e) + 1) for e in model.edges]
        bins, total = model._bins(self.x, model.edges), np.full(len(self.x), model.constant)
        for _ in range(ROUNDS):
            for f, table in enumerate(tables):
                p = _sigmoid(total)
                step = RATE * _tree(
                    np.bincount(bins[f], self.y - p, len(table)), np.bincount(bins[f], p * (1 - p), len(table))
                )
                table += step
                total += step[bins[f]]
        cells, p = model._bins(self.x, model.coarse), _sigmoid(total)
        gains = [_corner(*model._cells(cells, i, j, self.y - p, p * (1 - p)))[0] for i, j in model.possible()]
        return [np.concatenate(tables), np.array(gains)]

    def doubles(self, model: Additive) -> list[np.ndarray]:
        """Tables of the model's pairs, boosted on the residual of its single features."""
        tables = [np.zeros(t.shape) for _, _, t in model.pairs]
        cells, total = model._bins(self.x, model.coarse), model.singles(self.x)
        for _ in range(ROUNDS // 4):
            for (i, j, _), table in zip(model.pairs, tables):
                p = _sigmoid(total)
                step = RATE * _corner(*model._cells(cells, i, j, self.y - p, p * (1 - p)))[1]
                table += step
                total += step[cells[i], cells[j]]
        return [np.concatenate([t.ravel() for t in tables])]


# Asks every part for some arrays and returns their means by rows.
Means = Callable[[Callable[[Part], list[np.ndarray]]], list[np.ndarray]]


class Additive:
    """Lookup tables per feature and per chosen pair of features, of one part or of many."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        part = Part(x, y)
        self._fit(lambda ask: ask(part))

    @classmethod
    def of_parts(cls, means: Means) -> Additive:
        model = cls.__new__(cls)
        model._fit(means)
        return model

    def _fit(self, means: Means) -> None:
        quantiles, share = means(Part.quantiles)
        share = np.clip(share[0], 1e-3, 1 - 1e-3)
        self.constant = float(np.log(share / (1 - share)))
        self.edges = [np.unique(q) for q in quantiles[:len(GRID)].T]
        self.coarse = [np.unique(q) for q in quantiles[len(GRID):].T]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        tables, gains = means(lambda part: part.singles(self))
        self.tables = np.split(tables, np.cumsum([len(e) + 1 for e in self.edges])[:-1])
        chosen = sorted(((g, i, j) for g, (i, j) in zip(gains, self.possible())), reverse=True)[:PAIRS]
        self.pairs = [(i, j, np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1))) for _, i, j in chosen]
        (found,) = means(lambda part: part.doubles(self)) if self.pairs else [np.zeros(0)]
        at = 0
        for _, _, table in self.pairs:
            table += found[at:at + table.size].reshape(table.shape)
            at += table.size

    def possible(self) -> list[tuple[int, int]]:
        """The pairs of features that have more than one bin each."""
        return [(i, j) for i in range(len(self.coarse)) for j in range(i) if len(self.coarse[i]) and len(self.coarse[j])]

    @staticmethod
    def _bins(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, column, "left") for e, column in zip(edges, x.T)]

    def _cells(self, cells, i: int, j: int, *values):
        shape = (len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)
        flat = cells[i] * shape[1] + cells[j]
        return [np.bincount(flat, v, shape[0] * shape[1]).reshape(shape) for v in values]

    def singles(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.constant)
        for table, bins in zip(self.tables, self._bins(x, self.edges)):
            total += table[bins]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        total = self.singles(x)
        cells = self._bins(x, self.coarse)
        for i, j, table in self.pairs:
            total += table[cells[i], cells[j]]
        return _sigmoid(total)


def _slices(batches, text: int):
    """The rows of some batches in pieces of about BLOCK bytes of text, with their texts."""
    for batch in batches:
        column = batch.column(text)
        step = max(1, len(column) * BLOCK // max(1, column.nbytes))  # rows that are cast at once
        for first in range(0, len(column), step):
            for at, texts in blocks(column.slice(first, step), BLOCK):
                yield batch.slice(first + at, len(texts)), texts


def _measured(batches):
    for rows, texts in _slices(batches, 1):
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(list(measure(texts)), pa.list_(pa.float64()))], ["doc_id", "f"])


def _measured_and_scored(model: Additive):
    def run(batches):
        for rows, texts in _slices(batches, 1):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(model.score(measure(texts)), pa.float64())], ["doc_id", "score"])
    return run


def _scored(model: Additive):
    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])
    return run


def _means(table: DataFrame, n: int) -> Means:
    """Means over the parts of ``table`` (part, f, label; ``n`` rows). A task holds one part; its arrays are short at any size.

    Arrays are weighted by the part's share of the rows: those of a single part stay as they are.
    """
    schema = "part int,sums binary"

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        sums = [sum(arrays) for arrays in zip(*map(pickle.loads, pdf["sums"]))]
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "sums": [pickle.dumps(sums)]})

    def means(ask: Callable[[Part], list[np.ndarray]]) -> list[np.ndarray]:
        def asked(pdf: pd.DataFrame) -> pd.DataFrame:
            found = ask(Part(np.stack(pdf["f"]), pdf["label"].to_numpy() > 0))
            return pd.DataFrame({"part": pdf["part"].iloc[:1], "sums": [pickle.dumps([v * (len(pdf) / n) for v in found])]})

        sums = table.groupBy("part").applyInPandas(asked, schema)
        sums = sums.groupBy(F.pmod("part", F.lit(32))).applyInPandas(added, schema)
        return pickle.loads(added(sums.toPandas())["sums"].iloc[0])
    return means


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the features of every row."""
    return with_id(docs, key, text).mapInArrow(released(_measured), "doc_id long, f array<double>")


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    modulus: int = 3, left_out: int = 1,
) -> tuple[Additive | float, DataFrame | None]:
    """The model of all labelled rows, or a constant score where the labels are of one kind.

    Few labels are sent to the texts, and only their texts are measured. Otherwise all rows are, and
    their stored ``features`` are the second result.
    """
    given, measured = training_rows(labels, label, modulus, left_out, None), None
    if is_small(given, SENT):
        own = with_id(docs, key, text).join(F.broadcast(given), "doc_id").select("doc_id", "text")
        known = features(own).join(F.broadcast(given), "doc_id")
    else:
        measured = stored(features(docs, key, text))
        known = measured.join(given, "doc_id")
    known = stored(known.select("doc_id", "f", "label"))
    n, ones = known.agg(F.count("*"), F.coalesce(F.sum((F.col("label") > 0).cast("long")), F.lit(0))).first()
    if ones in (0, n):
        return (1.0 if ones else 0.0), measured
    part = F.pmod(F.xxhash64("doc_id"), F.lit(-(-n // PART))).cast("int")
    return Additive.of_parts(_means(known.select(part.alias("part"), "f", "label"), n)), measured


def score(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    modulus: int = 3, left_out: int = 1,
) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model, measured = fit(docs, labels, key, text, label, modulus, left_out)
    rows = with_id(docs, key, text)
    if isinstance(model, float):
        scored = rows.select("doc_id", F.lit(model).alias("score"))
    elif measured is not None:
        scored = measured.mapInArrow(released(_scored(model)), "doc_id long, score double")
    else:
        scored = rows.mapInArrow(released(_measured_and_scored(model)), "doc_id long, score double")
    return scored.select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), modulus) == left_out, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, all their columns unchanged.

    The score is added next to the row itself, so nothing is joined or shuffled.
    """
    model, _ = fit(docs, labels, key, text)
    if isinstance(model, float):
        return docs if model >= least or model == 0.0 else docs.limit(0)

    position = docs.columns.index(text)

    def run(batches):
        for rows, texts in _slices(batches, position):
            yield rows.filter(pa.array(model.score(measure(texts)) >= least))
    return docs.mapInArrow(released(run), docs.schema)
