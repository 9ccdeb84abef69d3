"""Operators of a training-data pipeline: rules, deduplication, formatting, tokens, mixing, scoring."""
