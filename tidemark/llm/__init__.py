"""Operators for preparing training data: decontamination, deduplication, filtering, packing."""
