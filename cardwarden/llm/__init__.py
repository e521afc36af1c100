"""Operators for large text corpora: filters, deduplication, scoring and mixing of documents."""
