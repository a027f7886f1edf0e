"""Operators for preparing training data: sharding, chat formatting, search, filtering, deduplication, tokens."""
