"""Timing of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores. Every query runs to completion into a sink that drops the rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vitalscope.plans.registry import QUERIES
from vitalscope.session import local_session

HEADLINE = [
    "stopword_stats", "stopword_list", "remove_stopwords", "token_doc_freq",
    "normalize_text", "explain_stages", "fuzzy_correct", "close_match", "bilingual_preprocess",
    "word_freq_top", "vocab_word", "vocab_char", "attention_weights", "dedupe_texts",
    "corpus_profile", "leakage_audit", "stratified_split", "kfold_assign",
    "cluster_summary", "cluster_pairs", "separation_gap", "group_similarity", "arm_summary",
    "nn_closed", "nn_open", "topk_similar", "vector_contract", "pca_2d",
    "confusion_matrix", "class_report", "method_selection", "fold_summary",
    "repair_numeric", "safe_category", "median_impute_scale", "cache_enrich", "bow_features",
    "batch_score",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "vitalscope-bench", "16g")
    wanted = [name for name in HEADLINE if len(sys.argv) == 1 or name in sys.argv[1:]]
    # Start the JVM, the Python workers and the code cache before the clock.
    QUERIES["fuzzy_correct"](spark, "/root/testdata/sf0.001" if os.path.isdir("/root/testdata/sf0.001") else folder).count()
    times = {}
    for name in wanted:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
