"""Training-data operators: text deduplication, scoring, tokenising, packing and vector search.

Nothing else in the library imports this subpackage.
"""
