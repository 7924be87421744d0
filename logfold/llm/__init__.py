"""Operators of a training-data pipeline: quality, duplicates, personal data, licenses, tokens."""
