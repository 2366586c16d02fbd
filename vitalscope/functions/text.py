"""Text expressions: cleaning, rules, canonical forms, tokens and n-grams."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .lookup import WordMap, in_words

# Python's idea of whitespace: Unicode spaces and the four separator controls.
SPACE = r"\s\x1c-\x1f"


def as_text(col: Column, default: str = "") -> Column:
    return F.coalesce(col.cast("string"), F.lit(default))


def strip(col: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(col, f"(?U)^[{SPACE}]+|[{SPACE}]+$", "")


def clean_text(col: Column) -> Column:
    """Lower-case; everything but a-z and whitespace becomes one space each."""
    return F.regexp_replace(F.lower(col), f"(?U)[^a-z{SPACE}]", " ")


def tokenize(col: Column) -> Column:
    """Whitespace tokens without empty ones."""
    return F.filter(F.split(col, f"(?U)[{SPACE}]+"), lambda w: w != "")


def letter_tokens(col: Column) -> Column:
    """``tokenize(clean_text(col))`` in one pass over the text."""
    return F.regexp_extract_all(F.lower(col), F.lit("[a-z]+"), F.lit(0))


def join_tokens(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def apply_phrase_rules(col: Column, rules: list[tuple[str, str]]) -> Column:
    """Substring replacements, one after the other in the given order."""
    for old, new in rules:
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


def map_tokens(tokens: Column, words: WordMap) -> Column:
    return F.transform(tokens, words.get_or_same) if words.mapping else tokens


def collapse_stutter(source: Column, canonical: Column) -> Column:
    """Drop a token whose canonical form repeats the one before it although
    the source words differ; a word repeated in the source stays.

    Each pair meets the pair before it, so the work grows with the tokens.
    """
    pairs = F.arrays_zip(source.alias("w"), canonical.alias("c"))
    before = F.concat(F.array(F.lit(None).cast("struct<w:string,c:string>")), pairs)

    def keep(now: Column, previous: Column) -> Column:
        repeats = (now["c"] == previous["c"]) & (now["w"] != previous["w"])
        return F.when(~F.coalesce(repeats, F.lit(False)), now["c"])

    return F.array_compact(F.zip_with(pairs, before, keep))


def drop_words(tokens: Column, words) -> Column:
    return F.filter(tokens, lambda w: ~in_words(w, words))


def remove_stopwords(text: Column, tokens: Column, words) -> Column:
    """Text without ``words``; the text as it was when nothing would be left."""
    if not words:
        return text
    kept = drop_words(tokens, words)
    return F.when(F.size(kept) == 0, text).otherwise(join_tokens(kept))


def word_tokens(text: Column) -> Column:
    """Runs of two or more word characters, lower-cased."""
    return lower_word_tokens(F.lower(text))


def lower_word_tokens(text: Column) -> Column:
    """``word_tokens`` of a text that is in lower case."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def word_ngrams(tokens: Column) -> Column:
    """Unigrams followed by bigrams."""
    following = F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))
    pairs = F.zip_with(
        F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))),
        following,
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.concat(tokens, pairs)


def char_ngrams_of_word(word: Column, low: int = 2, high: int = 4) -> Column:
    """Character n-grams of one word padded with a space on both sides."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    sizes = F.array(*[F.lit(n) for n in range(low, high + 1)])
    return F.flatten(
        F.transform(
            F.filter(sizes, lambda n: F.length(padded) >= n),
            lambda n: F.transform(
                F.sequence(F.lit(1), F.length(padded) - n + 1),
                lambda start: F.substring(padded, start, n),
            ),
        )
    )


def char_ngrams(text: Column, low: int = 2, high: int = 4) -> Column:
    """Character n-grams inside the padded words of a text."""
    words = tokenize(F.lower(text))
    return F.flatten(F.transform(words, lambda w: char_ngrams_of_word(w, low, high)))


def passage_prefix(text: Column) -> Column:
    """Prefix for passage encoders; a blank text gets a stand-in."""
    body = F.coalesce(F.nullif(strip(text), F.lit("")), F.lit("empty complaint"))
    return F.concat(F.lit("passage: "), body)
