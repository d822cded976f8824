"""Operators of a training-data pipeline: mixing, tokens, filters, near copies, search and sharding."""
