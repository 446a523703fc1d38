"""Training-data operators (mixing, near-duplicates, filters, scans, tokens).

Nothing else in the library imports this subpackage.
"""
