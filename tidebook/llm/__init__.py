"""Operators for preparing training data: deduplication, scoring, sharding, mixing and output at corpus scale.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
