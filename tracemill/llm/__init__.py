"""Training-data operators: mixing, near-duplicates, extraction, filtering, formatting, sharding.

Nothing outside this subpackage imports it.
"""
