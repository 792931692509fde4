"""Training-data operators: filtering, deduplication, formatting, packing, tokenisation.

Nothing outside this package imports it; it can be deleted without harm to the rest.
"""
