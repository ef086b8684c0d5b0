"""Operators for training data: scans, deduplication, decontamination, mixing, classifiers and sharding.

Nothing outside this package and ``corpus_pipeline.py`` imports it.
"""
