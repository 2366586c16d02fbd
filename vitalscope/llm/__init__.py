"""Operators for large training corpora: dedup, quality, toxicity, personal
data, decontamination, tokens, shards, archives and vector search.

Nothing else in the library imports this subpackage. Results carry the integer
``doc_id`` of the documents they speak about.
"""
