"""Operators of a training-data pipeline: secrets, token shards, near-duplicates, chat
repair, URL rules, source mixing, repeated passages, language, contamination, quality."""
