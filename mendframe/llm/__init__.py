"""Operators for training-data corpora: filtering, deduplication, mixing, encoding."""
