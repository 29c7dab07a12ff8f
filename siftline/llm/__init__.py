"""Training-data operators: filtering, deduplication, search, tokenisation and packing.

Nothing outside this subpackage imports it.
"""
