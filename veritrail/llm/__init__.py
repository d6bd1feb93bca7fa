"""Training-data operators: sharding, language ID, token output, dedup, mixing, WARC.

Nothing else in the library imports this subpackage.
"""
