"""Operators for preparing large text corpora: dedup, filters, mixing, sharding, tokenising."""
