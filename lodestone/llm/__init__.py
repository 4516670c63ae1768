"""Training-data operators: filters, scans, packing, mixing, near duplicates,
vector search, media storage and language-model scoring.

Nothing outside this subpackage imports it; ``queries`` holds the registered
queries and ``corpus_pipeline`` (repository top) chains five of the operators.
"""
