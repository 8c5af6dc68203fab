"""Operators of a training-data pipeline: search, deduplication, mixing, tokens, scoring, language and quality."""
