"""The rule-based two-language preprocessor."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType, StructField, StructType

from .. import lexicon as lx
from ..functions import text as tx
from ..functions.fuzzy import CloseMatcher, _Remembered as remembered, split_words, text_parts
from ..functions.lookup import in_words
from ..session import with_evaluated

FIELDS = [
    "corrected_english", "corrected_roman_urdu", "mapped_from_roman", "english_portion", "roman_urdu_portion",
    "english_without_stopwords", "roman_without_stopwords", "mapped_english_representation", "truncated_chief_complaint",
]


@dataclass(frozen=True)
class BilingualLexicon:
    english: list[str] = field(default_factory=lambda: list(lx.ENGLISH_TERMS))
    helpers: list[str] = field(default_factory=lambda: list(lx.ENGLISH_HELPERS))
    roman: dict[str, str] = field(default_factory=lambda: dict(lx.ROMAN_TO_ENGLISH))
    stopwords: list[str] = field(default_factory=lambda: list(lx.ROMAN_STOPWORDS))
    misspellings: dict[str, str] = field(default_factory=lambda: dict(lx.KNOWN_MISSPELLINGS))
    phrases: list[tuple[str, str]] = field(default_factory=lambda: list(lx.ROMAN_PHRASES))
    priority: list[str] = field(default_factory=lambda: list(lx.PRIORITY_TERMS))
    cutoff: float = 0.8
    max_words: int = 7


class _Ladder:
    """Exact misspelling -> known word -> close match -> the word itself."""

    def __init__(self, misspellings: dict[str, str], known: list[str], cutoff: float):
        self.misspellings, self.known = misspellings, frozenset(known)
        self.close = CloseMatcher(known, cutoff)

    def __call__(self, words: list[str]):
        unknown = [w for w in words if w not in self.misspellings and w not in self.known]
        close = dict(zip(unknown, self.close(unknown)))
        return [
            (self.misspellings[w], 1.0) if w in self.misspellings else close.get(w) for w in words
        ]


def _joined(number: np.ndarray, row: np.ndarray, words: list[str], rows: int) -> pa.Array:
    """A text per row: its words, by their numbers in the order given, with a space between."""
    offsets = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    values = pa.array(words, pa.string()).take(pa.array(number, pa.int64()))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), " ")


def _rows_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(different words, number and row of every word) of some texts."""
    words, number, ends = split_words(texts)
    return words, number, np.repeat(np.arange(len(texts)), np.diff(ends))


def _distinct(number: np.ndarray, row: np.ndarray, size: int) -> np.ndarray:
    """Places of the first of equal words of a row."""
    return np.sort(np.unique(row * max(1, size) + number, return_index=True)[1])


def _fields_udf(lex: BilingualLexicon, english_ladder, roman_ladder, close_ladder):
    """string in lower case -> struct of FIELDS. One worker looks at a text once; every different word is looked up once per part."""
    own, wanted = {*lex.english, *lex.helpers}, {*lex.priority, *lex.english}
    stop = frozenset(lex.stopwords)
    ladders = [remembered(x) for x in (english_ladder, roman_ladder, close_ladder)]

    def repaired(ladder, words: list[str], chosen: np.ndarray) -> list[str]:
        """The words with those that are chosen repaired."""
        out = list(words)
        if len(chosen):
            for i, m in zip(chosen.tolist(), ladder([words[i] for i in chosen.tolist()])):
                out[i] = m[0] if m else words[i]
        return out

    def marked(words: list[str], some) -> np.ndarray:
        return np.array([w in some for w in words], bool)

    def part(texts: pa.Array) -> pa.Array:
        n = len(texts)
        words, number, row = _rows_of(texts)
        is_own, kept = marked(words, own)[number], ~marked(words, stop)[number]

        def shown(chosen: np.ndarray, spelled: list[str]) -> pa.Array:
            return _joined(number[chosen], row[chosen], spelled, n)

        en, ro = is_own & kept, ~is_own & kept
        fixed_en = shown(en, repaired(ladders[0], words, np.unique(number[en])))
        fixed_ro = shown(ro, repaired(ladders[1], words, np.unique(number[ro])))

        # English for the phrases found, in rule order; a phrase is looked for in what those before it have left.
        rest, phrases, of = fixed_ro, [], []
        for phrase, english in lex.phrases:
            found = pc.match_substring(rest, phrase).to_numpy(zero_copy_only=False) if phrase else np.ones(n, bool)
            of.append(np.flatnonzero(found))
            phrases += [english]
            if phrase and found.any():
                rest = pc.replace_substring(rest, phrase, "")
        close, at, close_row = _rows_of(rest)
        mapped = [lex.roman.get(w, w) for w in repaired(ladders[2], close, np.arange(len(close)))]
        ids: dict[str, int] = {}
        named = np.array([ids.setdefault(w, len(ids)) for w in phrases + mapped], np.int64)
        every = np.concatenate([named[:len(phrases)].repeat([len(x) for x in of]), named[len(phrases):][at]])
        rows = np.concatenate([*of, close_row])
        order = np.argsort(rows, kind="stable")
        every, rows = every[order], rows[order]
        first = _distinct(every, rows, len(ids))
        from_roman = _joined(every[first], rows[first], list(ids), n)

        parts = [_rows_of(x) for x in (fixed_en, from_roman)]
        ids = {}
        every = np.concatenate([
            np.array([ids.setdefault(w, len(ids)) for w in w_], np.int64)[i] for w_, i, _ in parts])
        rows = np.concatenate([r for _, _, r in parts])
        order = np.argsort(rows, kind="stable")
        every, rows = every[order], rows[order]
        first = _distinct(every, rows, len(ids))
        every, rows, names = every[first], rows[first], list(ids)
        whole = _joined(every, rows, names, n)
        important = marked(names, wanted)[every]
        some, some_rows = every[important], rows[important]
        starts = np.searchsorted(some_rows, np.arange(n))
        short = np.arange(len(some)) - starts[some_rows] < lex.max_words
        matters = np.bincount(some_rows, minlength=n) > 0
        truncated = pc.if_else(pa.array(matters), _joined(some[short], some_rows[short], names, n), whole)
        return pa.StructArray.from_arrays([
            fixed_en, fixed_ro, from_roman, shown(is_own, words), shown(~is_own, words), shown(en, words), shown(ro, words),
            whole, truncated,
        ], FIELDS)

    @arrow_udf(StructType([StructField(name, StringType()) for name in FIELDS]))
    def fields(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([part(rows) for rows in text_parts(texts)] or [part(texts)])

    return fields


class BilingualPreprocessor:
    def __init__(self, lexicon: BilingualLexicon | None = None):
        lex = self.lexicon = lexicon or BilingualLexicon()
        roman_words = list(lex.roman)
        self._fields = _fields_udf(
            lex,
            _Ladder(lex.misspellings, lex.english, lex.cutoff),
            _Ladder(lex.misspellings, roman_words, lex.cutoff),
            _Ladder({}, roman_words, lex.cutoff),
        )

    def split(self, tokens: Column) -> tuple[Column, Column]:
        """English tokens and the others, order kept."""
        english = self.lexicon.english + self.lexicon.helpers
        return (
            F.filter(tokens, lambda w: in_words(w, english)),
            F.filter(tokens, lambda w: ~in_words(w, english)),
        )

    def truncate(self, text: Column) -> Column:
        """The first words that matter, or the whole text when none does."""
        wanted = self.lexicon.priority + self.lexicon.english
        important = F.filter(tx.tokenize(text), lambda w: in_words(w, wanted))
        return F.when(F.size(important) == 0, text).otherwise(
            tx.join_tokens(F.slice(important, 1, self.lexicon.max_words))
        )

    def process(self, df: DataFrame, text: str) -> DataFrame:
        """Add every field of the result, all of them in one look at a text."""
        fields = with_evaluated(
            df.drop(*FIELDS[:3]), "_fields", self._fields(F.lower(tx.as_text(F.col(text))))
        )
        return fields.withColumns({name: F.col("_fields")[name] for name in FIELDS}).drop("_fields")
