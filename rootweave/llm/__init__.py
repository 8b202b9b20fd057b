"""Training-data operators: deduplication, filtering, tokenisation, packing and exact search.

Nothing outside this subpackage imports it.
"""
