"""Operators for large text corpora: packing, counting, extraction, privacy, duplicates, quality.

``queries`` registers them; nothing outside this folder and ``corpus_pipeline`` imports it.
"""
