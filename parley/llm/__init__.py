"""Operators of a training-data pipeline: formatting, counting, deduplication, filters and classifiers."""
