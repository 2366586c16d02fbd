"""The registered queries by name."""

from __future__ import annotations

from . import catalog, catalog_models

_NAMES = [
    "token_doc_freq", "df_cutoff", "stopword_stats", "stopword_list", "stopword_reasons",
    "stopword_except", "watchlist_intersect", "protected_in_corpus", "remove_stopwords",
    "explain_kept", "stopword_report",
    "clean_text", "clean_pages", "phrase_rules", "canonical_forms", "normalize_text", "preprocess_text",
    "explain_stages", "fuzzy_correct", "close_match", "bilingual_split", "bilingual_truncate",
    "bilingual_preprocess",
    "word_frequencies", "word_freq_top", "vocab_word", "vocab_char", "attention_weights",
    "dedupe_texts", "corpus_profile", "label_levels", "changed_rows", "single_class_tokens",
    "leakage_audit", "category_determinism", "record_contradictions",
    "stratified_split", "kfold_assign", "sample_n", "sample_per_lang", "meaning_clusters",
    "rare_class_filter", "class_weights",
    "cluster_pairs", "cluster_summary", "separation_gap", "group_similarity", "arm_summary",
    "two_arm_comparison", "pair_check", "pair_check_summary", "nn_closed", "nn_open",
    "nn_efficiency", "nn_misses", "topk_similar", "topk_summary", "topk_one_query",
    "vector_profile", "vector_contract", "vector_cosines", "pca_2d", "block_scale",
    "confusion_matrix", "confusion_wide", "triage_errors", "class_rates", "error_patterns",
    "class_report", "report_averages", "method_table", "method_selection", "method_override",
    "baseline_delta", "method_ablation", "fold_metrics", "fold_summary", "best_macro_f1", "usable_rows", "display_row_ids",
    "repair_numeric", "range_flags", "safe_category", "no_text_guard", "passage_prefix",
    "level_labels", "median_impute_scale", "onehot", "generic_structured", "wide_to_long",
    "cache_enrich", "pending_rows", "enrich_status", "enrich_run",
]

QUERIES: dict[str, catalog.Query] = {name: getattr(catalog, name) for name in _NAMES}
QUERIES.update(catalog_models.QUERIES)
