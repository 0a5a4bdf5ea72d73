"""Operators of a training-data pipeline: quality, tokens, shuffling, duplicates, decontamination, scoring."""
