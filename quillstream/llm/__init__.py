"""Operators for large text corpora: near duplicates, personal data, secrets, toxicity, mixing, search and tokens."""
