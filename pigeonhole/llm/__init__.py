"""Operators for training-data corpora: packing, deduplication, decontamination, scoring and formatting."""
