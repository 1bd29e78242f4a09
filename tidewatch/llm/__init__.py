"""Operators and queries that prepare text corpora for model training."""
