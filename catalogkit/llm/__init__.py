"""Operators for preparing large text collections: sharding, language, quality, duplicates, packing.

Nothing outside this folder, its tests and ``corpus_pipeline.py`` imports it.
"""
