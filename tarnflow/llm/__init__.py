"""Training-data operators: near and exact dedup, tokens, packing, WARC, URL rules, language ID.

Nothing else in the library imports this subpackage.
"""
