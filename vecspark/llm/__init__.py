"""Training-data operators: search, scoring, deduplication, encoding and packing of corpora.

Nothing outside this package imports it; the package can be deleted as a whole.
"""
