"""Operators for preparing training data: near-duplicates, tokens, toxicity, licences, packing, search."""
