"""Corpus preparation operators: scans, deduplication, sharding, mixing, tokens and media."""
