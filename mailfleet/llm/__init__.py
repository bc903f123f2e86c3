"""Operators for large text corpora: cleaning, deduplication, scoring and tokenisation."""
