"""Operators for preparing training data: dedup, scans, search, mixing, tokens, chat."""
