"""Queries over the given tables, one per operator or small family of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import repair, text as tx, vectors as vx
from ..lexicon import REVIEW_WORDS, TERM_WEIGHTS, Lexicon
from ..operators import corpus, enrich, evaluation, features, models, sampling, similarity, stopwords, wide
from ..operators.bilingual import BilingualPreprocessor
from ..operators.fuzzy_table import close_matches
from ..operators.normalize import Normalizer
from ..session import small_side, spread
from ..sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]

# Dictionaries for the test corpus, whose words are made of English syllables.
LEXICON = Lexicon(
    variants={
        "and": "ánd", "nd": "ánd", "thnd": "ánd", "ernd": "ánd",
        "an": "ān", "anan": "ān", "es": "ēs", "is": "ēs", "be": "bē", "by": "bē",
        "heart": "hārt", "breath": "brēth",
    },
    rules=[("in the", "inthe"), ("thth", "th"), ("tion", "shun"), ("of the", "ofthe")],
    fillers={"er": "re", "ou": "of"},
)
PROTECTED = sorted(Lexicon().protected_terms() | {"the", "and", "thing"})
WATCH = sorted(set(REVIEW_WORDS) | {"not", "no", "was", "this", "are"})
SEED = 42


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text", *columns))


def document_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", tx.letter_tokens(F.col("text")).alias("tokens"))


def document_labels(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, label: four classes from the two marks of a document."""
    marks = table(spark, folder, "labels")
    return marks.select("doc_id", (F.col("quality") * 2 + F.col("toxic")).cast("int").alias("label"))


def labelled_tokens(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).join(small_side(document_labels(spark, folder)), "doc_id")
    return docs.select("doc_id", "label", tx.letter_tokens(F.col("text")).alias("tokens"))


def token_stats(spark: SparkSession, folder: str, docs: DataFrame | None = None) -> DataFrame:
    docs = labelled_tokens(spark, folder) if docs is None else docs
    return stopwords.token_statistics(docs, protected=PROTECTED)


# ---- stop words ---------------------------------------------------------------

def token_doc_freq(spark, folder):
    freq = stopwords.document_frequency(document_tokens(spark, folder))
    return freq.withColumn("document_frequency", F.round("document_frequency", 8))


def df_cutoff(spark, folder):
    freq = stopwords.document_frequency(document_tokens(spark, folder))
    return stopwords.df_cutoff(freq).select(F.round("count_cutoff", 6).alias("count_cutoff"))


def stopword_stats(spark, folder):
    return stopwords.with_p_value(token_stats(spark, folder)).select(
        "token", "document_count",
        F.round("document_frequency", 4).alias("document_frequency"),
        F.round("nmi", 6).alias("nmi"), F.round("cramers_v", 6).alias("cramers_v"),
        F.round("chi_square", 4).alias("chi_square"), "chi_square_dof",
        F.round("p_value", 6).alias("p_value"),
        "is_high_frequency", "is_uninformative", "is_protected", "is_stopword",
    )


def stopword_list(spark, folder):
    return stopwords.stopword_list(token_stats(spark, folder))


def stopword_reasons(spark, folder):
    return token_stats(spark, folder).select("token", stopwords.reason().alias("reason"))


def stopword_except(spark, folder):
    docs = labelled_tokens(spark, folder)
    train = sampling.stratified_split(docs, "doc_id", "label", 0.2, SEED).filter("NOT is_test")
    return stopwords.difference_both_ways(
        stopwords.stopword_list(token_stats(spark, folder)),
        stopwords.stopword_list(token_stats(spark, folder, train.drop("is_test"))),
        ("all_rows", "train_rows"),
    )


def watchlist_intersect(spark, folder):
    return stopwords.review_recommended(token_stats(spark, folder), WATCH)


def protected_in_corpus(spark, folder):
    freq = stopwords.document_frequency(document_tokens(spark, folder))
    return freq.filter(F.col("token").isin(PROTECTED)).select("token", "document_count")


def remove_stopwords(spark, folder):
    docs = documents(spark, folder).withColumn("tokens", tx.letter_tokens(F.col("text")))
    stops = stopwords.stopword_list(token_stats(spark, folder))
    cleaned = stopwords.remove_stopwords(docs, stops, "doc_id")
    return cleaned.select("doc_id", "text_without_stopwords")


def explain_kept(spark, folder):
    return stopwords.explain_kept(document_tokens(spark, folder), token_stats(spark, folder), "doc_id")


def stopword_report(spark, folder):
    docs = labelled_tokens(spark, folder)
    report = writers.stopword_report(
        token_stats(spark, folder, docs), stopwords.Thresholds(), WATCH, docs.count(), [0, 1, 2, 3])
    return report.select(
        "corpus.n_tokens_tested", "corpus.n_documents",
        *[F.array_join(c, " ").alias(c)
          for c in ("stopwords", "protected_from_removal", "review_recommended")])


# ---- text stages ----------------------------------------------------------------

def clean_text(spark, folder):
    return documents(spark, folder).select("doc_id", tx.clean_text(F.col("text")).alias("cleaned"))


def clean_pages(spark, folder):
    pages = spread(table(spark, folder, "pages"))
    return pages.select("page_id", tx.join_tokens(tx.letter_tokens(F.col("html"))).alias("cleaned"))


def phrase_rules(spark, folder):
    tokens = Normalizer(LEXICON).ruled_tokens(F.col("text"))
    return documents(spark, folder).select("doc_id", tx.join_tokens(tokens).alias("ruled"))


def canonical_forms(spark, folder):
    n = Normalizer(LEXICON)
    docs = documents(spark, folder).select("doc_id", n.ruled_tokens(F.col("text")).alias("t"))
    mapped = docs.withColumn("m", n.mapped_tokens(F.col("t")))
    collapsed = tx.collapse_stutter(F.col("t"), F.col("m"))
    return mapped.select("doc_id", tx.join_tokens(collapsed).alias("canonical"))


def normalize_text(spark, folder):
    docs = Normalizer(LEXICON).normalize(documents(spark, folder), "text")
    return docs.select("doc_id", "normalized")


def preprocess_text(spark, folder):
    """Normalized text without a stop-word list, as the encoder reads it."""
    docs = Normalizer(LEXICON).preprocess(documents(spark, folder), "text", ["the", "ánd", "in"])
    return docs.select("doc_id", "preprocessed")


def explain_stages(spark, folder):
    stages = Normalizer(LEXICON).explain(documents(spark, folder), "doc_id", "text", ["the", "ánd"])
    return stages.select("doc_id", "stage_no", "stage", F.md5("text").alias("text_md5"), "changed",
                         "dropped")


def fuzzy_correct(spark, folder):
    n = Normalizer(LEXICON)
    docs = documents(spark, folder).select(n.ruled_tokens(F.col("text")).alias("t"))
    found = n.repairs(docs.select(F.explode("t").alias("token")))
    return found.withColumn("score", F.round("score", 6))


def close_match(spark, folder):
    docs = document_tokens(spark, folder)
    terms = sorted(TERM_WEIGHTS)
    return close_matches(docs.select(F.explode("tokens").alias("token")), terms, 0.8)


def bilingual_preprocess(spark, folder):
    out = BilingualPreprocessor().process(documents(spark, folder), "text")
    return out.drop("text")


def bilingual_split(spark, folder):
    b = BilingualPreprocessor()
    en, ro = b.split(F.col("t"))
    drop = b.lexicon.stopwords
    docs = documents(spark, folder).select("doc_id", tx.tokenize(F.lower("text")).alias("t"))
    return docs.select(
        "doc_id", tx.join_tokens(en).alias("english_portion"),
        F.md5(tx.join_tokens(ro)).alias("roman_md5"),
        tx.join_tokens(tx.drop_words(en, drop)).alias("english_without_stopwords"),
        F.md5(tx.join_tokens(tx.drop_words(ro, drop))).alias("roman_without_stopwords_md5"),
    )


def bilingual_truncate(spark, folder):
    cut = BilingualPreprocessor().truncate(F.col("unique_words"))
    words = tx.join_tokens(F.array_distinct(tx.tokenize(F.lower("text"))))
    docs = documents(spark, folder).select("doc_id", words.alias("unique_words"))
    return docs.select("doc_id", F.md5(cut).alias("truncated_md5"))


# ---- corpus -----------------------------------------------------------------------

def word_freq_top(spark, folder):
    return corpus.top_words(corpus.word_frequencies(documents(spark, folder)))


def word_frequencies(spark, folder):
    return corpus.word_frequencies(documents(spark, folder))


def vocab_word(spark, folder):
    return corpus.word_vocabulary(documents(spark, folder))


def vocab_char(spark, folder):
    return corpus.char_vocabulary(documents(spark, folder))


def attention_weights(spark, folder):
    docs = documents(spark, folder)
    weights = TERM_WEIGHTS | {"tion": 1.2, "the": 0.4, "ther": 1.7, "in": 0.9, "this": 1.1}
    vocab = corpus.word_vocabulary(docs).unionByName(corpus.char_vocabulary(docs))
    return features.weigh_vocabulary(vocab, weights)


def dedupe_texts(spark, folder):
    return corpus.distinct_texts(documents(spark, folder), "doc_id").select("doc_id", "copies")


def corpus_profile(spark, folder):
    docs = documents(spark, folder).withColumn("tokens", tx.letter_tokens(F.col("text")))
    return corpus.profile(docs)


def label_levels(spark, folder):
    docs = document_labels(spark, folder)
    levels = corpus.class_distribution(docs, "label", range(6))
    return levels.withColumn("share", F.round("share", 8))


def changed_rows(spark, folder):
    docs = Normalizer(LEXICON)
    rows = documents(spark, folder).select(
        tx.join_tokens(tx.letter_tokens(F.col("text"))).alias("before"),
        tx.join_tokens(docs.ruled_tokens(F.col("text"))).alias("after"),
    )
    return corpus.changed_rows(rows, "before", "after")


def leakage_audit(spark, folder):
    return corpus.leakage_audit(labelled_tokens(spark, folder), "doc_id")


def single_class_tokens(spark, folder):
    return corpus.single_class_tokens(labelled_tokens(spark, folder))


def category_determinism(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source")
    rows = docs.join(small_side(document_labels(spark, folder)), "doc_id")
    out = corpus.category_determinism(rows, "source", "label")
    return out.withColumn("max_class_share", F.round("max_class_share", 8))


def record_contradictions(spark, folder):
    docs = documents(spark, folder, "lang", "n_chars")
    found = corpus.record_contradictions(
        F.col("text"), F.col("lang"), F.col("n_chars"),
        F.when(F.col("n_chars") > 2000, 1).otherwise(4),
        text_conflicts={"en": ["tione", "thethe"], "fr": ["queque"]},
        rate_bounds={"de": (100, 3000), "es": (50, 5000)},
        red_flags=["that it", "von der"], reassurance=["in the", "of the"],
    )
    return docs.select("doc_id", F.array_join(found, ",").alias("contradictions"))


# ---- splits and samples -----------------------------------------------------------------

def stratified_split(spark, folder):
    return sampling.stratified_split(document_labels(spark, folder), "doc_id", "label", 0.2, SEED)


def kfold_assign(spark, folder):
    return sampling.stratified_folds(document_labels(spark, folder), "doc_id", "label", 5, SEED)


def sample_n(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return sampling.sample_exactly(docs, "doc_id", 50, SEED)


def sample_per_lang(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return sampling.sample_per_group(docs, "doc_id", "lang", 20, SEED)


MEANINGS = {
    "heads": [["heart"], ["head", "th"]],
    "things": [["thing", "that"]],
    "nations": [["nation"]],
    "nothing": [["zzzzzz"]],
}


def meaning_clusters(spark, folder):
    docs = documents(spark, folder).select("doc_id", F.lower("text").alias("text"))
    return sampling.meaning_clusters(docs, "doc_id", "text", MEANINGS, 10, SEED)


def rare_class_filter(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    kept = sampling.large_enough_groups(customers, "c_nationkey", 60)
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    named = kept.join(small_side(nations), kept.c_nationkey == nations.n_nationkey)
    return named.select("c_custkey", "n_name")


def class_weights(spark, folder):
    weights = sampling.class_weights(document_labels(spark, folder), "label")
    return weights.withColumn("weight", F.round("weight", 8))


# ---- vectors ------------------------------------------------------------------------------

def vectors(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", "embedding", "label")


def clustered(spark, folder):
    return vectors(spark, folder).filter("label < 7")


def pool(spark, folder):
    return vectors(spark, folder).filter("label >= 7")


def _rounded(df, digits, *names):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def cluster_pairs(spark, folder):
    pairs = similarity.pairs_above(vectors(spark, folder), "vec_id", "embedding", "label", 0.25)
    return _rounded(pairs, 6, "cosine_similarity", "pearson_correlation", "euclidean_distance")


_SUMMARY = ["mean_cosine_similarity", "min_cosine_similarity", "max_cosine_similarity",
            "mean_pearson_correlation", "mean_euclidean_distance", "pct_above"]


def cluster_summary(spark, folder):
    summary = similarity.cluster_summary(vectors(spark, folder), "vec_id", "embedding", "label")
    named = summary.withColumn("cluster", F.col("cluster").cast("string"))
    whole = named.unionByName(similarity.overall_row(named))
    banded = whole.withColumn("band", repair.pass_rate_band(F.col("pct_above")))
    return _rounded(banded, 4, *_SUMMARY)


def separation_gap(spark, folder):
    out = similarity.separation(vectors(spark, folder), "vec_id", "embedding", "label")
    return _rounded(out, 6, *[c for c in out.columns if not c.endswith("pairs")])


def group_similarity(spark, folder):
    out = similarity.group_similarity(vectors(spark, folder), "vec_id", "embedding", "label")
    return _rounded(out, 4, "mean_similarity", "median_similarity", "min_similarity",
                    "max_similarity")


def arm_summary(spark, folder):
    out = similarity.arm_summary(vectors(spark, folder), "vec_id", "embedding", "label", 0.3)
    return _rounded(out, 6, "within", "across", "gap", "pass_rate")


def _smoothed_vectors(spark, folder):
    """A second encoding of the same rows, as long as the first: each place plus the next one."""
    wide_ = F.col("embedding").cast("array<double>")
    return vectors(spark, folder).withColumn(
        "embedding", F.transform(wide_, lambda x, i: x + F.get(wide_, F.pmod(i + 1, F.size(wide_)))))


def two_arm_comparison(spark, folder):
    arms = [similarity.arm_summary(df, "vec_id", "embedding", "label", 0.3)
            for df in (vectors(spark, folder), _smoothed_vectors(spark, folder))]
    out = similarity.compare_arms(*arms, names=("plain", "smoothed"))
    return _rounded(out, 6, *[c for c in out.columns if c not in ("cluster", "n_pairs")])


def pair_checks(spark, folder):
    """Every row is paired with the next one by key; documented is the clipped
    similarity rounded to one digit."""
    rows = vectors(spark, folder)
    ids = rows.select(F.col("vec_id").alias("left_id"), (F.col("vec_id") + 1).alias("right_id"))
    pairs = ids.select(F.col("left_id").alias("pair_id"), "left_id", "right_id",
                       F.lit(0.1).alias("documented"))
    return similarity.pair_check(pairs, rows, _smoothed_vectors(spark, folder), "vec_id", "embedding",
                                 threshold=0.3, tolerance=0.1)


def pair_check(spark, folder):
    return _rounded(pair_checks(spark, folder), 6, "raw", "normalized", "lift", "drift")


def pair_check_summary(spark, folder):
    out = similarity.pair_check_summary(pair_checks(spark, folder))
    return _rounded(out, 6, "mean_raw", "mean_normalized", "mean_lift")


def nn_closed(spark, folder):
    out = similarity.nearest_closed(vectors(spark, folder), "vec_id", "embedding", "label")
    return _rounded(out.withColumnRenamed("key", "vec_id"), 6, "similarity")


def _open(spark, folder):
    mine = clustered(spark, folder)
    closed = similarity.nearest_closed(mine, "vec_id", "embedding", "label")
    return similarity.nearest_open(closed, mine, pool(spark, folder), "vec_id", "embedding")


def nn_open(spark, folder):
    out = _open(spark, folder).withColumnRenamed("key", "vec_id")
    return _rounded(out, 6, "similarity")


def nn_efficiency(spark, folder):
    found = _open(spark, folder)
    by_cluster = similarity.neighbour_efficiency(found, by_cluster=True)
    overall = similarity.neighbour_efficiency(found).withColumn("cluster", F.lit(-1))
    out = by_cluster.unionByName(overall)
    return _rounded(out, 4, "efficiency_closed_pct", "efficiency_open_pct")


def nn_misses(spark, folder):
    closed = similarity.nearest_closed(vectors(spark, folder), "vec_id", "embedding", "label")
    return similarity.misses(closed).select("key", "true_cluster", "neighbour", "neighbour_cluster")


def topk_similar(spark, folder):
    out = similarity.top_similar(pool(spark, folder), clustered(spark, folder), "vec_id", "embedding")
    banded = out.withColumn("verdict", repair.match_verdict(F.col("similarity")))
    return _rounded(banded, 6, "similarity")


def topk_summary(spark, folder):
    out = similarity.top_similar(pool(spark, folder), clustered(spark, folder), "vec_id", "embedding")
    sums = out.groupBy("query").agg(F.avg("similarity").alias("mean_similarity"),
                                    F.min("similarity").alias("min_similarity"))
    return _rounded(sums, 6, "mean_similarity", "min_similarity")


def topk_one_query(spark, folder):
    rows = vectors(spark, folder)
    target = rows.orderBy("vec_id").limit(1).first()["embedding"]
    out = similarity.top_similar_to(rows, "embedding", target, 6)
    return _rounded(out.select("vec_id", "label", "similarity"), 6, "similarity")


def vector_profile(spark, folder):
    out = similarity.vector_profile(vectors(spark, folder), "vec_id", "embedding")
    return _rounded(out, 6, "norm", "total", "low", "high")


def vector_contract(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"))
    return similarity.vector_contract(vectors(spark, folder), "vec_id", "embedding", docs, 64)


def pca_2d(spark, folder):
    points, explained = models.components(vectors(spark, folder), "vec_id", "embedding")
    return _rounded(
        points.withColumn("explained_1", F.lit(explained[0])).withColumn(
            "explained_2", F.lit(explained[1])), 6, "pc1", "pc2", "explained_1", "explained_2")


def block_scale(spark, folder):
    from pyspark.ml.functions import array_to_vector

    block = vectors(spark, folder).select(array_to_vector("embedding").alias("block"))
    return _rounded(features.block_scale(block, "block"), 6, "mean_column_sd", "mean_abs_nonzero")


# ---- evaluation -----------------------------------------------------------------------------------

def order_predictions(spark, folder):
    """Priority as the true class, a price rule as the prediction."""
    return table(spark, folder, "orders").select(
        "o_orderkey",
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("label"),
        F.least(F.lit(4), F.floor(F.col("o_totalprice") / 100000)).cast("int").alias("prediction"),
    )


def method_predictions(spark, folder):
    """Three ways to predict the class of an order, in long form."""
    orders = table(spark, folder, "orders")
    label = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    ways = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(name).alias("method"), value.cast("int").alias("prediction"))
        for i, (name, value) in enumerate([
            ("price", F.least(F.lit(4), F.floor(F.col("o_totalprice") / 100000))),
            ("customer", F.pmod(F.col("o_custkey"), F.lit(5))),
            ("status", F.when(F.col("o_orderstatus") == "F", 1).otherwise(2)),
        ])
    ])
    return orders.select("o_orderkey", label.alias("label"), F.explode(ways).alias("w")).select("o_orderkey", "label", "w.*")


def order_cells(spark, folder):
    return evaluation.confusion(order_predictions(spark, folder))


def confusion_matrix(spark, folder):
    return evaluation.confusion_grid(order_cells(spark, folder))


def confusion_wide(spark, folder):
    return evaluation.confusion_wide(order_cells(spark, folder), 5)


_RATES = ["accuracy", "under_triage_pct", "over_triage_pct"]


def triage_errors(spark, folder):
    return _rounded(evaluation.error_rates(order_cells(spark, folder)), 6, *_RATES)


def class_rates(spark, folder):
    out = evaluation.class_rates(order_cells(spark, folder))
    return _rounded(out, 6, "correct_rate", "over_triage_rate", "under_triage_rate")


def error_patterns(spark, folder):
    return _rounded(evaluation.error_patterns(order_cells(spark, folder)), 6, "share_pct")


def class_report(spark, folder):
    out = evaluation.weak_classes(evaluation.class_report(order_cells(spark, folder)))
    return _rounded(out, 6, "precision", "recall", "f1")


def report_averages(spark, folder):
    out = evaluation.report_averages(evaluation.class_report(order_cells(spark, folder)))
    return _rounded(out, 6, *[c for c in out.columns if c != "support"])


def method_results(spark, folder):
    keys = ["ord", "method"]
    rates = evaluation.error_rates(evaluation.confusion(method_predictions(spark, folder), by=keys), keys)
    return _rounded(rates, 2, *_RATES)


def method_table(spark, folder):
    return method_results(spark, folder)


def method_selection(spark, folder):
    results = method_results(spark, folder)
    picks = [("safety_first", evaluation.select_method(results)),
             ("most_accurate", evaluation.most_accurate(results))]
    out = None
    for name, pick in picks:
        row = pick.select(F.lit(name).alias("pick"), "method", *_RATES)
        out = row if out is None else out.unionByName(row)
    return out


def method_override(spark, folder):
    out = evaluation.override_cost(method_results(spark, folder), "customer")
    return _rounded(out, 4, "under_triage_cost", "accuracy_gain")


def baseline_delta(spark, folder):
    out = evaluation.against_baseline(method_results(spark, folder), "price")
    return _rounded(out, 4, "accuracy_change", "under_triage_change")


def method_ablation(spark, folder):
    out = evaluation.ablation(method_results(spark, folder), "price", "status")
    return _rounded(out, 4, "accuracy_change", "under_triage_change")


def fold_metrics(spark, folder):
    folds = sampling.stratified_folds(order_predictions(spark, folder), "o_orderkey", "label", 5, SEED)
    out = evaluation.fold_metrics(folds)
    return _rounded(out, 6, *_RATES, "macro_f1")


def fold_summary(spark, folder):
    folds = sampling.stratified_folds(order_predictions(spark, folder), "o_orderkey", "label", 5, SEED)
    out = evaluation.fold_summary(evaluation.fold_metrics(folds))
    return _rounded(out, 6, *[c for c in out.columns if c != "safety_grade"])


def best_macro_f1(spark, folder):
    """The way to predict an order's class with the highest mean macro F1 over five folds."""
    ways = method_predictions(spark, folder)
    folds = ways.withColumn("fold", F.pmod("o_orderkey", F.lit(5)).cast("int"))
    out = evaluation.fold_summary(evaluation.fold_metrics(folds, by=("ord", "method")), by=("ord", "method"))
    best = evaluation.best_by_macro_f1(out).select("method", "macro_f1_mean", "macro_f1_std", "accuracy_mean")
    return _rounded(best, 6, "macro_f1_mean", "macro_f1_std", "accuracy_mean")


# ---- numbers, categories, guards ------------------------------------------------------------------------

def messy_events(spark, folder):
    """Cells as they come in messy files: blank, padded, broken or fine."""
    k = F.get_json_object("props", "$.k")
    cell = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("l"), k))
        .when(F.col("event_type") == "click", F.concat(F.lit(" "), k, F.lit(" ")))
        .when(F.col("event_type") != "signup", k)
    )
    return table(spark, folder, "events").select("event_id", "event_type", "value", cell.alias("cell"))


def repair_numeric(spark, folder):
    cell = F.col("cell")
    return messy_events(spark, folder).select(
        "event_id", repair.safe_number(cell, 50.5).alias("number"),
        repair.parsed_number(cell).isNull().alias("substituted"),
        F.coalesce(repair.number_note("k", cell), F.lit("")).alias("note"),
    )


def range_flags(spark, folder):
    flags = repair.range_flags(
        {"value": F.col("value"), "k": repair.parsed_number(F.col("cell"))},
        {"value": (1, 100), "k": (10, 90)},
    )
    return messy_events(spark, folder).select("event_id", F.array_join(flags, ",").alias("flags"))


def safe_category(spark, folder):
    raw = F.when(F.col("o_custkey") % 2 == 1, F.lower("o_orderstatus")).otherwise(
        F.concat(F.lit(" "), F.col("o_orderstatus")))
    classes = ["F", "O"]
    return table(spark, folder, "orders").select(
        "o_orderkey", repair.safe_category(raw, classes).alias("category"),
        F.coalesce(repair.category_note("status", raw, classes), F.lit("")).alias("note"),
    )


def no_text_guard(spark, folder):
    docs = documents(spark, folder, "n_chars").withColumn("tokens", tx.letter_tokens(F.col("text")))
    no_text = F.size("tokens") < 3
    confidence = (F.col("n_chars") % 100) / 100.0
    return docs.select(
        "doc_id", no_text.alias("no_text"),
        F.round(repair.capped_confidence(confidence, no_text), 6).alias("confidence"),
        repair.confidence_text(confidence, no_text).alias("shown"),
        (repair.capped_confidence(confidence, no_text) < repair.LOW_CONFIDENCE).alias("is_low"),
    )


def passage_prefix(spark, folder):
    return table(spark, folder, "benchmark").select(
        "item_id", tx.passage_prefix(F.col("text")).alias("passage"))


def level_labels(spark, folder):
    return document_labels(spark, folder).select(
        "doc_id", (F.col("label") + 1).alias("triage_level"), repair.level_label(F.col("label")).alias("name"))


def _customers(spark, folder):
    rows = table(spark, folder, "customer")
    return rows.withColumn("c_acctbal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))


def median_impute_scale(spark, folder):
    rows = _customers(spark, folder)
    s = features.Structured.fit(rows, ["c_acctbal", "c_nationkey"], ["c_mktsegment"])
    return rows.select(
        "c_custkey", F.round(s.number("c_acctbal"), 4).alias("filled"),
        F.round(s.scaled("c_acctbal"), 6).alias("scaled"),
    )


def onehot(spark, folder):
    rows = table(spark, folder, "customer")
    s = features.Structured.fit(rows, ["c_nationkey"], ["c_mktsegment"])
    flags = s.one_hot("c_mktsegment")
    return rows.select("c_custkey", s.code("c_mktsegment").alias("code"),
                       *[flag.alias(f"is_{i}") for i, flag in enumerate(flags)])


def wide_to_long(spark, folder):
    long = readers.wide_clusters(table(spark, folder, "part").select("p_brand", "p_type"))
    return long.groupBy("cluster", "text").agg(F.count("*").alias("n"))


def generic_structured(spark, folder):
    """The block of all columns of a table, split by type: scaled numbers and the place of each flag."""
    rows = table(spark, folder, "part")
    s = wide.generic_structured(rows, exclude=("p_partkey",))
    out, at = s.add_codes(rows), len(s.numeric)
    shown = [F.round(s.scaled(c), 6).alias(c) for c in s.numeric]
    for c in s.categorical:
        shown.append((F.col(f"{c}_code") + at).alias(f"{c}_at"))
        at += s.sizes[c]
    return out.select("p_partkey", *shown, F.lit(s.size).cast("long").alias("n_features"))


def usable_rows(spark, folder):
    """Documents with a text, language and source, stripped; some cells are blanked first."""
    docs = table(spark, folder, "documents").select(
        "doc_id", F.concat(F.lit(" \t"), "lang", F.lit(" \n")).alias("lang"),
        F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("source"),
        F.when(F.col("doc_id") % 7 == 0, "  \t").otherwise(F.col("text")).alias("text"),
    )
    return corpus.usable_rows(docs, ["lang", "source", "text"]).select("doc_id", "lang", "source")


def display_row_ids(spark, folder):
    """Orders numbered as they stand in the file."""
    return readers.in_file_order(table(spark, folder, "orders")).select("o_orderkey", "row_id")


# ---- enrichment ----------------------------------------------------------------------------------------------

def _cache(spark, folder):
    """What users wrote counts as already translated; long turns came back blank."""
    rows = table(spark, folder, "conversations").filter("role = 'user'")
    return rows.select("text", F.when(F.col("turn") <= 2, F.concat(F.lit("en: "), F.col("text"))).otherwise("").alias("translation"))


def _filled(spark, folder):
    rows = spread(table(spark, folder, "conversations").select("conv_id", "turn", "text"))
    return enrich.from_cache(rows, _cache(spark, folder), "text", "translation")


def cache_enrich(spark, folder):
    return _filled(spark, folder).select("conv_id", "turn", "translation", "status")


def pending_rows(spark, folder):
    return enrich.pending_texts(_filled(spark, folder), "text").select("text", "n_rows")


def enrich_status(spark, folder):
    return enrich.status_counts(_filled(spark, folder))


def enrich_run(spark, folder):
    """Pending texts through a user function inside the tasks."""
    rows = spread(table(spark, folder, "conversations").select("conv_id", "turn", "text"))
    out = enrich.enrich(
        rows, _cache(spark, folder), "text", "translation", "conv_id",
        lambda: lambda texts: [t[::-1] if len(t) < 400 else None for t in texts],
    )
    return out.select("conv_id", "turn", "translation", "status")


def vector_cosines(spark, folder):
    """Neighbouring rows compared by every pairwise measure."""
    rows = vectors(spark, folder)
    right = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    both = rows.join(right, "vec_id")
    a, b = F.col("embedding"), F.col("other")
    return both.select(
        "vec_id", F.round(vx.cosine(a, b), 6).alias("cosine"),
        F.round(vx.cosine_raw(a, b), 6).alias("cosine_raw"),
        F.round(vx.pearson(a, b), 6).alias("pearson"),
        F.round(vx.euclidean(a, b), 6).alias("euclidean"),
        F.round(vx.norm(vx.unit(a)), 6).alias("unit_norm"),
    )
