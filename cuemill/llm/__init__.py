"""Operators for training-data pipelines: deduplication, quality, language, licences, mixing and packing."""
