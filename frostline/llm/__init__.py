"""Operators for preparing text corpora: filters, deduplication, extraction, formatting, packing."""
