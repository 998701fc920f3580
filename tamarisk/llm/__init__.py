"""Operators for training-data pipelines: scoring, filters, scans, archives, duplicates."""
