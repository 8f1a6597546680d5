"""Training-data operators: deduplication, mixing, search, tokenizing, sharding, scoring.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
