"""Operators for building training corpora: matching, deduplication, mixing, tokenising and filtering of documents."""
