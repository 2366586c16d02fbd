"""Corpus counts, vocabularies, audits and data-quality scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.grams import pair_counts, token_counts
from ..functions.lookup import in_words
from ..lexicon import (
    HISTOGRAM_STOPWORDS, REASSURANCE_FRAGMENTS, RED_FLAG_FRAGMENTS, RHYTHM_HEART_RATE,
    RHYTHM_TEXT_CONFLICTS,
)
from ..session import SMALL_ROWS, checkpointed, small_rows, with_evaluated


def word_frequencies(docs: DataFrame, text: str = "text", stopwords=HISTOGRAM_STOPWORDS) -> DataFrame:
    """Word, Frequency over every occurrence; filler and one-letter words left out."""
    words = docs.select(F.explode(tx.tokenize(F.col(text))).alias("Word"))
    return (
        words.filter((F.length("Word") > 1) & ~in_words(F.col("Word"), stopwords))
        .groupBy("Word")
        .agg(F.count("*").alias("Frequency"))
    )


def top_words(frequencies: DataFrame, n: int = 30) -> DataFrame:
    """The ``n`` most frequent words, least frequent first."""
    top = frequencies.orderBy(F.desc("Frequency"), "Word").limit(n)
    return top.orderBy("Frequency", F.desc("Word"))


def lower_token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """token, n over every occurrence of a token of the lower-cased texts; tasks count before the shuffle."""
    partial = docs.select(F.lower(text).alias("text")).mapInArrow(token_counts, "token string, n long")
    return partial.groupBy("token").agg(F.sum("n").alias("n"))


def word_vocabulary(
    docs: DataFrame, text: str = "text", size: int = 350, tokens: DataFrame | None = None
) -> DataFrame:
    """The most frequent word uni- and bigrams: term, term_count.

    A pair occurs no more often than either of its words, so it can only be among the ``size``
    most frequent terms when both words are as frequent as the ``size``-th word. Only
    such pairs are counted; when ties leave too many words for a list, all pairs are.
    ``tokens`` are the ``lower_token_counts`` of ``docs``, if they exist already.
    """
    tokens = lower_token_counts(docs, text) if tokens is None else tokens
    singles = tokens.select(F.explode(tx.lower_word_tokens(F.col("token"))).alias("term"), "n")
    counts = singles.groupBy("term").agg(F.sum("n").alias("term_count"))
    rows = counts.orderBy(F.desc("term_count")).limit(SMALL_ROWS + 1).collect()
    least = rows[size - 1]["term_count"] if 0 < size <= len(rows) else 0
    words = tx.word_tokens(F.col(text))
    if len(rows) > SMALL_ROWS and rows[-1]["term_count"] >= least:
        words = with_evaluated(docs.select(text), "words", words)
        grams = words.select(F.explode(tx.word_ngrams(F.col("words"))).alias("term"))
        counts = grams.groupBy("term").agg(F.count("*").alias("term_count"))
    else:
        rows = [r for r in rows if r["term_count"] >= least]
        pairs = docs.select(words.alias("words")).mapInArrow(
            pair_counts(sorted(r["term"] for r in rows)), "term string, n long"
        ).groupBy("term").agg(F.sum("n").alias("term_count"))
        counts = docs.sparkSession.createDataFrame(rows, counts.schema).unionByName(pairs)
    return counts.orderBy(F.desc("term_count"), "term").limit(size)


def char_vocabulary(
    docs: DataFrame, text: str = "text", size: int = 350, low: int = 2, high: int = 4,
    tokens: DataFrame | None = None,
) -> DataFrame:
    """The most frequent character n-grams inside words: term, term_count.

    A gram never leaves its word, so words are counted first and only distinct
    words are cut into grams, each weighted by its count. ``tokens`` are the
    ``lower_token_counts`` of ``docs``, if they exist already.
    """
    words = (lower_token_counts(docs, text) if tokens is None else tokens).withColumnRenamed("token", "word")
    padded = words.select(F.concat(F.lit(" "), "word", F.lit(" ")).alias("p"), "n")
    starts = padded.select(
        "p", "n", F.explode(F.sequence(F.lit(1), F.length("p") - low + 1)).alias("start")
    )
    ends_inside = [
        F.when(
            F.col("start") + length - 1 <= F.length("p"),
            F.substring("p", F.col("start"), F.lit(length)),
        )
        for length in range(low, high + 1)
    ]
    grams = starts.select(F.explode(F.array(*ends_inside)).alias("term"), "n").filter(
        F.col("term").isNotNull()
    )
    counts = grams.groupBy("term").agg(F.sum("n").alias("term_count"))
    return counts.orderBy(F.desc("term_count"), "term").limit(size)


def distinct_texts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per distinct text with its smallest key and number of copies.

    Groups by a digest, so a hot text moves as 32 bytes and its copies are
    merged before the shuffle.
    """
    return docs.groupBy(F.sha2(text, 256).alias("text_hash")).agg(
        F.min(key).alias(key), F.count("*").alias("copies")
    )


def profile(docs: DataFrame, tokens: str = "tokens", text: str = "text") -> DataFrame:
    """One row: documents, distinct texts, vocabulary size, token total."""
    texts = docs.agg(
        F.count("*").alias("n_documents"),
        F.sum(F.size(tokens)).alias("n_tokens"),
    )
    distinct = (
        docs.groupBy(F.sha2(text, 256)).agg(F.lit(1)).agg(F.count("*").alias("n_distinct_texts"))
    )
    vocabulary = (
        docs.select(F.explode(F.array_distinct(tokens)).alias("token"))
        .groupBy("token")
        .agg(F.lit(1))
        .agg(F.count("*").alias("n_vocabulary"))
    )
    return texts.select(
        "n_documents",
        distinct.scalar().alias("n_distinct_texts"),
        vocabulary.scalar().alias("n_vocabulary"),
        "n_tokens",
    )


def class_distribution(df: DataFrame, label: str, levels=None) -> DataFrame:
    """label, n, share; with ``levels`` given, empty levels show with 0."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    if levels is not None:
        grid = df.sparkSession.createDataFrame(
            [(level,) for level in levels], f"label {dict(df.dtypes)[label]}"
        )
        counts = grid.join(counts, "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = df.agg(F.count("*")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def changed_rows(df: DataFrame, before: str, after: str) -> DataFrame:
    """One row: rows whose text differs between two stages."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.sum(F.when(~F.col(before).eqNullSafe(F.col(after)), 1).otherwise(0)).alias("n_changed"),
    )


def single_class_tokens(docs: DataFrame, tokens: str = "tokens", label: str = "label") -> DataFrame:
    """Tokens seen with one class only: token, label, document_count."""
    return (
        docs.select(F.col(label).alias("label"), F.explode(F.array_distinct(tokens)).alias("token"))
        .groupBy("token")
        .agg(
            F.min("label").alias("label"),
            F.max("label").alias("last"),
            F.count("*").alias("document_count"),
        )
        .filter(F.col("label") == F.col("last"))
        .drop("last")
    )


def leakage_audit(
    docs: DataFrame, key: str, tokens: str = "tokens", label: str = "label", hot_share: float = 0.02
) -> DataFrame:
    """One row: label-revealing tokens and the share of rows holding one.

    Tokens of many documents would make hot join keys. They are few (see
    ``learned_words``), so rows holding a revealing one are found in the scan
    and only the long tail of rare tokens is joined.
    """
    n_docs = docs.count()
    # Written once, read four times below.
    table = checkpointed(
        docs.select(F.col(label).alias("label"), F.explode(F.array_distinct(tokens)).alias("token"))
        .groupBy("token")
        .agg(
            F.count("*").alias("document_count"),
            (F.min("label") == F.max("label")).alias("reveals"),
        )
    )
    revealing = table.filter("reveals").select("token")
    rows = small_rows(
        table.filter(F.col("document_count") >= hot_share * n_docs).select("token", "reveals")
    )
    pairs = docs.select(key, F.explode(F.array_distinct(tokens)).alias("token"))
    if rows is None:
        holding = pairs.join(revealing, "token", "left_semi").select(key)
    else:
        hot = [r["token"] for r in rows]
        hot_revealing = [r["token"] for r in rows if r["reveals"]]
        rare = pairs.filter(~in_words(F.col("token"), hot))
        holding = rare.join(revealing, "token", "left_semi").select(key)
        if hot_revealing:
            holding = holding.union(
                docs.filter(F.exists(tokens, lambda w: in_words(w, hot_revealing))).select(key)
            )
    held = holding.distinct().agg(F.count("*").alias("n_rows_holding"))
    totals = table.agg(F.struct(F.count("*").alias("n"), F.count_if("reveals").alias("r"))).scalar()
    return held.select(
        totals["n"].alias("n_tokens"),
        totals["r"].alias("n_revealing_tokens"),
        "n_rows_holding",
        F.lit(n_docs).cast("long").alias("n_rows"),
    )


def category_determinism(df: DataFrame, category: str, label: str) -> DataFrame:
    """Per category value: rows, classes seen and the largest class share."""
    cells = df.groupBy(F.col(category).alias("category"), F.col(label).alias("label")).agg(
        F.count("*").alias("n")
    )
    return cells.groupBy("category").agg(
        F.sum("n").alias("n_rows"),
        F.count("*").alias("n_classes"),
        (F.max("n") / F.sum("n")).alias("max_class_share"),
    )


def _contains_any(text: Column, fragments) -> Column:
    found = F.lit(False)
    for fragment in fragments:
        found = found | F.contains(text, F.lit(fragment))
    return found


def record_contradictions(
    text: Column, rhythm: Column, heart_rate: Column, level: Column,
    text_conflicts=RHYTHM_TEXT_CONFLICTS, rate_bounds=RHYTHM_HEART_RATE,
    red_flags=RED_FLAG_FRAGMENTS, reassurance=REASSURANCE_FRAGMENTS,
) -> Column:
    """Names of the contradictions inside one record.

    Text against rhythm, heart rate against rhythm, a red flag at a low
    acuity (levels 3-4), reassurance at a high one (levels 1-2).
    """
    low = F.lower(text)
    checks = []
    for name, fragments in text_conflicts.items():
        checks.append(F.when((rhythm == name) & _contains_any(low, fragments), "text_vs_rhythm"))
    for name, (least, most) in rate_bounds.items():
        checks.append(
            F.when((rhythm == name) & ~heart_rate.between(least, most), "rate_vs_rhythm")
        )
    checks.append(F.when((level >= 3) & _contains_any(low, red_flags), "red_flag_at_low_acuity"))
    checks.append(
        F.when((level <= 2) & _contains_any(low, reassurance), "reassurance_at_high_acuity")
    )
    return F.array_distinct(F.array_compact(F.array(*checks)))


def usable_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that have a value in all of ``columns``, white space of any kind stripped from the text ones.

    A null, empty or blank cell is no value.
    """
    types = dict(df.dtypes)
    own = {c: tx.strip(F.col(c)) for c in columns if types[c] == "string"}
    kept = df.withColumns(own) if own else df
    for c in columns:
        kept = kept.filter(F.col(c).isNotNull() & (F.col(c) != "") if c in own else F.col(c).isNotNull())
    return kept
