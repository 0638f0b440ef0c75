"""Operators of a training-data pipeline: cleaning, de-duplication, sharding, formatting, tokens."""
