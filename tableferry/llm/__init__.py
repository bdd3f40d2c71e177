"""Training-data operators: search, fingerprints, filters, dedup, tokens, sharding.

Nothing else in the library imports this subpackage.
"""
