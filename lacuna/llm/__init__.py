"""Operators of a training-data pipeline: deduplication, filtering, tokens, chat records and shards."""
