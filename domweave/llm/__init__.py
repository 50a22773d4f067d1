"""Operators for large training-data corpora: cleaning, matching, scoring, packing and archives.

Nothing outside this package and ``corpus_pipeline.py`` imports it.
"""
