"""Operators for training data at scale: dedup, packing, classifiers, extraction, scans, tokens, language model."""
