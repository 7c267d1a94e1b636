"""Operators of training-data pipelines: deduplication, scoring, tokens, packing, search. Nothing outside imports it."""
