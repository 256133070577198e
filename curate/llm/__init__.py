"""Operators of a training-data pipeline: classifiers, near-duplicates, packing, tokens, extraction, search."""
