"""Training-data operators: deduplication, tokenization, scoring, packing, archives and search.

Nothing else in the library imports this subpackage. ``registry`` lists its queries.
"""
